"""Models of labelled identifiers and random strings: what they find, what they leave, and the base columns in plain Python."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from capturelake.llm import secrets

SYLLABLES = "ta re mo li con ver sa ti on er ing ble pre de su per in ter na ma ho use get set lo ad".split()
# names of public programs and libraries' style, none of whose words the corpus has
ORDINARY = """getElementsByClassNameAndSelectorAll AbstractSingletonProxyFactoryBean com/example/project/Service/UserController
BackgroundTaskSchedulerConfigurationProvider IllegalArgumentExceptionHandlerFactory XMLHttpRequestEventTargetPolyfill
my-long-slug-with-many-words-2024 MAX_BUFFER_SIZE_IN_BYTES v1/api/users/12345/orders/67890 org_apache_spark_sql_DataFrame
usr/local/share/doc/package-1.2.3/README 2024-01-15_09-30-00_backup_full release-candidate-2024_06_30 internationalisation_of_names
DEFAULT_CONNECTION_TIMEOUT_SECONDS src/main/java/org/example/Application python3-dateutil-2_8_2-py3 camelCaseIdentifierWithNumber42
ThisIsAnotherPascalCaseName snake_case_function_name_v2 kebab-case-component-name 20240115093000123 1234567890123456789""".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 300)) for i in range(400)]
    keys = ["password", "PassWd", "Secret", "TOKEN", "apikey", "api_key", "API_KEY"]
    for i in range(400, 520):
        value = "".join(rng.choice(secrets.ALPHABET + "+/_.=-") for _ in range(rng.randint(1, 30)))
        gap = rng.choice(["=", " = ", '": "', "' :", ":", "=='"])
        key = "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(rng.randint(10, 24)))
        digits = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(18, 50)))
        parts = [f"{rng.choice(keys)}{gap}{value}", key, digits, f"x{digits}{key}", f"{rng.choice(keys)}={rng.choice(keys)}={value}", "İ token=ſecretvalue"]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "", "\n", "é"]).join(parts[: rng.randint(1, 6)])))
    rows += [(600, None), (601, ""), (602, "token=" * 3000), (603, "AKIA" * 5000), rows[0], rows[450], (None, rows[460][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def models(docs):
    return secrets.train(docs)


def test_held_out_samples_set_the_level(models):
    assert models.level >= 0 and models.false_share <= secrets.FALSE_SHARE and models.recall >= 0.9


def test_ordinary_names_stay(models):
    rng = random.Random(5)
    names = list(ORDINARY)
    for text in (prose(rng, 6) for _ in range(600)):
        names += secrets.identifiers(text)
    wrong = [n for n in names if secrets.find(f"see {n} there", models)]
    assert not [n for n in ORDINARY if n in wrong]
    assert len(wrong) <= 0.002 * len(names), wrong


@pytest.mark.parametrize("kind", ["base62", "base64", "base36", "base32"])
def test_random_strings_are_found(models, kind):
    rng = random.Random(kind)
    letters = {"base62": secrets.ALPHABET, "base36": secrets.ALPHABET[26:], "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    found = 0
    for _ in range(400):
        n = rng.randint(24, 44)
        value = base64.b64encode(rng.randbytes(n))[:n].decode() if kind == "base64" else "".join(rng.choice(letters[kind]) for _ in range(n))
        found += any(k == 3 and b - a >= 0.6 * n for a, k, b in secrets.find(f"the {value} here", models))
    assert found >= 0.95 * 400


def test_level_comes_from_kinds_of_names_held_out(models):
    """At most 5 in 100 of each kind that training lacks are found, and 9 in 10 of random strings of every alphabet."""
    assert set(models.found) == {secrets.ORDINARY, *secrets.OTHERS, *secrets.RANDOM}
    assert all(models.found[k] <= secrets.KIND_SHARE for k in secrets.OTHERS) and all(models.found[k] >= 0.9 for k in secrets.RANDOM), models.found


def test_one_kind_of_names_raises_the_level(spark, models):
    """7 of 100 builds exceed a rate of 1: the level goes over it, and the strings below are not found any more."""
    at = lambda rate: int(secrets.np.searchsorted(secrets.RATES, rate))
    rows = [("identifiers", 0, 1000), ("build", 0, 93), ("build", at(1.0), 7), ("pod", 0, 97), ("pod", at(3.0), 3), ("base62", at(0.5), 10), ("base62", at(2.0), 90)]
    fitted = secrets.with_level(models, spark.createDataFrame(rows, "kind string, bin int, n long"))
    assert 1.0 <= fitted.level < 1.1 and fitted.found == {"identifiers": 0.0, "build": 0.0, "pod": 0.03, "base62": 0.9}


@pytest.mark.parametrize("name", [
    "MacBookPro18-3_BuildXcode15A240d", "2024-01-31T12-30-45Z_backup_v2", "sha256sum-CHECK-mk2-r7", "kubernetes-dashboard-7d9f8c6b5-x2k4p",
    "libgcc-s1-arm64-cross_10.2.1-6cross1_all", "ingress-nginx-controller-6d4b75cb6d-hm9vq", "Win10_22H2_EnglishInternational_x64v1", "IMG_20240131_123045_HDR_edited",
])
def test_names_of_other_programs(models, name):
    assert secrets.find(f"see {name} for it", models) == []


def brute(text):
    """The base spans as the contract words them, straight from its patterns."""
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:p)(?i:a)(?i:s)(?i:s)(?i:w)(?i:o)(?i:r)(?i:d)|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:p)(?i:a)(?i:s)(?i:s)(?i:w)(?i:o)(?i:r)(?i:d)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]"), text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_columns_against_plain_python(docs, models):
    rows = secrets.scan(docs, models).join(docs.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(r["text"])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        base = [s for s in r["spans"].split(",") if s and not s.startswith("markov")]
        assert ",".join(base) == said


def test_tables_without_rows_or_samples(spark, models):
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = secrets.train(none)
    assert empty.level >= 0 and secrets.scan(none, empty).count() == 0
    assert [tuple(r)[:5] for r in secrets.scan(spark.createDataFrame([(1, None)], "doc_id long, text string"), models).collect()] == [(1, 0, 0, 0, 0)]
