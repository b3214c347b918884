"""Random strings that share a run with words or with a fixed pattern are found."""

import random

import pytest

from capturelake.llm import secrets

BASE62 = secrets.ALPHABET[:62]
WORDS = ["configuration", "transportation", "internationalisation", "characterisation", "responsibility"]

#: A word of each letter, so that the models know every row.
LETTERS = "about back come down even first great have into just know like make never over people queue right some take under very with extra year zero".split()


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(4)
    forms = (str.lower, str.title, str.upper, lambda _: str(rng.randrange(10**6)))
    rows = [(i, " ".join(rng.choice(forms)(rng.choice(WORDS + LETTERS)) for _ in range(2000))) for i in range(20)]
    rows += [(100 + i, "token=" + "".join(rng.choice(BASE62) for _ in range(40))) for i in range(1000)]
    return secrets.fit(secrets.labelled_steps(spark.createDataFrame(rows, "doc_id long, text string")))


def some(rng, n):
    return "".join(rng.choice(BASE62) for _ in range(n))


@pytest.mark.parametrize("sign", ["/", "_", "-"])
@pytest.mark.parametrize("words", [2, 6, 8, 12, 60])
def test_behind_and_before_words(models, sign, words):
    rng = random.Random(words)
    for _ in range(20):
        secret, plain = some(rng, 24), sign.join(rng.choice(WORDS) for _ in range(words))
        for text in (f"see {plain}{sign}{secret} now", f"see {secret}{sign}{plain} now", f"see {plain}{sign}{secret}{sign}{plain} now"):
            at = text.index(secret)
            assert any(a <= at and at + 24 <= b for a, _, b in secrets.find(text, models)), text


def test_two_in_one_run(models):
    rng = random.Random(1)
    plain = "/".join(WORDS * 4)
    one, two = some(rng, 32), some(rng, 32)
    text = f"{plain}/{one}/{plain}/{two}/{plain}"
    left = secrets.mask(text, secrets.find(text, models))
    assert one not in left and two not in left
    assert [text[len(plain) + 1 :][a:b] for a, b in models.stretches(text[len(plain) + 1 :], secrets.THRESHOLD)] == [one, two]


def test_beside_fixed_patterns(models):
    rng = random.Random(2)
    key, secret = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), some(rng, 40)
    for text in (f"{key}/{secret}", f"{secret}/{key}", f"{secret}/{key}/{secret}", f"{WORDS[0]}/{WORDS[1]}/{key}/{WORDS[2]}/{secret}"):
        found = secrets.find(text, models)
        assert [s for s in found if s[1] < 3] == [s[:3] for s in secrets.base_spans(text)]
        assert secret not in secrets.mask(text, found) and key not in secrets.mask(text, found), text
    assert secrets.mask(f"{key}/{WORDS[0]}-{WORDS[1]}", secrets.find(f"{key}/{WORDS[0]}-{WORDS[1]}", models)) == f"<access>/{WORDS[0]}-{WORDS[1]}"


def test_plain_runs_stay(models):
    rng = random.Random(3)
    for _ in range(50):
        plain = rng.choice("/_-").join(rng.choice(WORDS) for _ in range(30))
        assert not secrets.find(f"a {plain} b", models), plain
