"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import documents
from capturelake.llm.tokens import slices

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Texts that have none of these in lower case have no assignment.
KEYS = ("passw", "secret", "token", "api")

#: Characters whose steps the models have. Signs join ordinary names (paths, slugs, rules of dashes) as well as random ones.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Shortest run that is scored.
SHORTEST = 16
#: Fewest different steps of a random stretch inside a longer piece; a build's number is shorter.
STRETCH = 12
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DASHES = re.compile("[-_]")
#: Nats by which a string must be likelier as random than as an identifier: the least evidence, whatever its length.
THRESHOLD = 12.0
#: The rate, nats a step, that a string must exceed too is the least one that held-out identifiers exceed no oftener than this.
FALSE_SHARE = 0.001
#: The same for names of kinds that no training sample has.
KIND_SHARE = 0.05
#: One labelled text in so many is held out from the counts.
HELD_OUT = 10
#: Edges of the bins of rates in which held-out samples are counted.
RATES = np.linspace(-4, 4, 401)
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
N = len(ALPHABET)
_KIND = np.array([0 if c.isupper() else 1 if c.islower() else 2 for c in ALPHABET])
BACKED = 0.3


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns, each kind leftmost and without overlaps."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run of 24 hex digits lies in a long run of the alphabet, and maximal runs don't depend on where the search began
    for run in LONG_RUN.finditer(text):
        out += [(run.start() + m.start(), 2, run.start() + m.end(), m[0]) for m in HEX.finditer(run[0]) if len(m[0]) >= 24]
    return sorted(out)


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of each step between characters: random against ordinary.

    ``level``: nats a step that a random string exceeds; ``found``: the share of held-out samples that are found at it, by kind of name and
    alphabet of random strings (empty: nothing was held out).
    """

    ratio: np.ndarray
    level: float = 0.0
    found: dict[str, float] = field(default_factory=dict)

    @property
    def false_share(self) -> float | None:
        """Share of held-out identifiers that are found (None: nothing was held out)."""
        return self.found.get(ORDINARY)

    @property
    def recall(self) -> float | None:
        """Share of random strings that are found, over the alphabet with the fewest."""
        return min((share for kind, share in self.found.items() if kind in RANDOM), default=None)

    def _scored(self, value: str) -> tuple[float, float]:
        """Sum over the value's steps, and its mean. A step that the value repeats counts once, so one letter many times is no evidence."""
        seen = _steps(value.encode()) > 0
        total = float(self.ratio.reshape(-1)[seen].sum())
        return total, total / max(int(seen.sum()), 1)

    def score(self, value: str) -> float:
        return self._scored(value)[0]

    def core_rate(self, value: str, threshold: float) -> float:
        """The best rate of an unbroken piece between dashes of SHORTEST characters or more that is evidence enough by itself, as a
        whole or by a stretch of STRETCH steps; -inf without one.

        Names of builds, dates and pods hold short random pieces; many of them in a row are still a name.
        """
        best = -np.inf
        for piece in DASHES.split(value):
            if len(piece) >= SHORTEST:
                total, rate = self._scored(piece)
                best = max([best, *([rate] if total > threshold else []), *(r for _, _, r, n in self._best(piece, threshold) if n >= STRETCH)])
        return best

    def random(self, value: str, threshold: float) -> bool:
        """Is the whole value likelier random, in sum and by the step, and a piece of it, too?"""
        total, rate = self._scored(value)
        return total > threshold and rate > self.level and self.core_rate(value, threshold) > self.level

    def stretches(self, value: str, threshold: float) -> list[tuple[int, int]]:
        """Parts of the value that look random though the whole need not: best stretches of steps, each ended where its sum has
        fallen from its best by the threshold. A step counts once in a stretch, and a stretch below 0 is left.

        A stretch is widened to the ends of the pieces between signs that it begins and ends in.
        """
        found = []
        for a, b, rate, _ in self._best(value, threshold):
            if rate > self.level and self.core_rate(value[a:b], threshold) > self.level:
                if found and a <= found[-1][1]:
                    a = found.pop()[0]
                found.append((a, b))
        return found

    def _best(self, value: str, threshold: float) -> Iterator[tuple[int, int, float, int]]:
        """(start, end, rate, different steps) of the stretches, whatever their rate."""
        codes = _CODE[np.frombuffer(value.encode(), np.uint8)].astype(np.int64)
        steps = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * N + codes[1:], -1)
        gain = np.where(steps >= 0, self.ratio.reshape(-1)[steps], 0.0)
        if gain[gain > 0].sum() <= threshold:
            return
        gain, steps = gain.tolist(), steps.tolist()
        i = start = end = count = 0
        total = best = 0.0
        last: set[int] = {-1}
        while i <= len(steps):
            if best > threshold and (i == len(steps) or total <= best - threshold):
                a, b = start, end + 1
                while a > 0 and value[a - 1] not in "/_-":
                    a -= 1
                while b < len(value) and value[b] not in "/_-":
                    b += 1
                yield a, b, best / max(count, 1), count
                i = start = end = max(b - 1, end)
                total, best, last = 0.0, 0.0, {-1}
            if i < len(steps):
                if steps[i] not in last:
                    total += gain[i]
                    last.add(steps[i])
                if total > best:
                    best, end, count = total, i + 1, len(last) - 1
                elif total <= 0:
                    total, best, start, end, last = 0.0, 0.0, i + 1, i + 1, {-1}
            i += 1

    def top_rate(self, value: str, threshold: float) -> float:
        """The rate that decides whether any of the value is found: the best of the whole and its stretches."""
        total, rate = self._scored(value)
        whole = [min(rate, self.core_rate(value, threshold))] if total > threshold else []
        return max([*whole, *(min(r, self.core_rate(value[a:b], threshold)) for a, b, r, _ in self._best(value, threshold))], default=-np.inf)


def _log_steps(counts: np.ndarray) -> np.ndarray:
    """Log chance of each next character. A share BACKED of it is the chance of its kind (capital, small letter, digit) after a
    character of that kind, so that a pair of letters which the corpus' words don't have is no proof by itself."""
    counts = counts.reshape(N, N) + 0.5
    kinds = np.zeros((3, 3))
    np.add.at(kinds, (_KIND[:, None], _KIND[None, :]), counts)
    by_kind = kinds / kinds.sum(axis=1, keepdims=True) / np.bincount(_KIND)[None, :]
    return np.log((1 - BACKED) * counts / counts.sum(axis=1, keepdims=True) + BACKED * by_kind[_KIND[:, None], _KIND[None, :]])


def _steps(data: bytes) -> np.ndarray:
    codes = _CODE[np.frombuffer(data, np.uint8)].astype(np.int64)
    pair = codes[:-1] * N + codes[1:]
    return np.bincount(pair[(codes[:-1] >= 0) & (codes[1:] >= 0)], minlength=N * N)


def _table(alphabet: str) -> bytes:
    return bytes(ord(alphabet[i % len(alphabet)]) for i in range(256))


#: Alphabets of the random samples, as tables from a digest's bytes.
BASE62, BASE36, BASE32 = map(_table, (ALPHABET, "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E), *b"/_-"]] = True


def random_samples(text: str) -> list[bytes]:
    """Strings of 64 characters or so over several alphabets, from digests of the text: the same in every run."""
    one, two = hashlib.sha512(text.encode()).digest(), hashlib.blake2b(text.encode()).digest()
    return [one.translate(BASE62), two.translate(BASE62), base64.b64encode(one), two.translate(BASE36), one.translate(BASE32), two[:32].hex().encode()]


def camel(data: bytes) -> bytes:
    """WordsJoinedLikeThis."""
    x = np.frombuffer(data, np.uint8)
    gap = _GAPS[x]
    first = np.ones(len(x), bool)
    first[1:] = gap[:-1]
    return np.where(first & (x >= 97) & (x <= 122), x - 32, x).astype(np.uint8)[~gap].tobytes()


def numbered(text: str, words: list[str]) -> str:
    """Names with numbers: versions, dates, times, counters, made of a text's first words and its checksum."""
    h = zlib.crc32(text.encode())
    date = f"20{h % 30:02}{h % 12 + 1:02}{h % 28 + 1:02}"
    plain = [w for w in words if w.isascii() and w.isalpha()][:4]
    tails = [f"{h % 10}", f"{h % 100}", f"V{h % 10}", f"{1 << h % 10}"]
    return f"v{h % 7}.{h % 31}.{h % 101} {date} {date}{h % 24:02}{h % 60:02}{h % 59:02} {h % 10000} " + " ".join(map(str.__add__, plain, tails))


def identifiers(text: str) -> list[str]:
    """Ordinary names of SHORTEST characters or more, made of four words of a text: camel case, snake case, a slug, a path, names with numbers."""
    words = re.findall("[A-Za-z]+", text)
    if not words:
        return []
    h = zlib.crc32(text.encode())
    w = [x.lower() for x in (words * 4)[h % len(words) :][:4]]
    title = [x.capitalize() for x in w]
    made = [w[0] + "".join(title[1:]), "".join(title), "_".join(w), "-".join(w), "_".join(w).upper(), "/".join([w[0], w[1], *title[2:]]), f"{'-'.join(w)}-{h % 9}_{h % 40}", f"{title[0]}{title[1]}V{h % 10}/{w[2]}{h % 100}_{title[3]}"]
    return [x for x in made if len(x) >= SHORTEST]


#: Letters and digits of generated name endings, as a table from a digest's bytes.
ENDINGS = _table("bcdfghjklmnpqrstvwxz2456789")


def held_kinds(text: str) -> dict[str, list[str]]:
    """Ordinary names of kinds that no training sample has: builds, dated files, package files, pods, checksums and machines; of four words of a text,
    its checksum and digest."""
    words = re.findall("[A-Za-z]+", text)
    if not words:
        return {}
    h, ends = zlib.crc32(text.encode()), hashlib.sha256(text.encode()).digest().translate(ENDINGS).decode()
    w = [x.lower() for x in (words * 4)[h % len(words) :][:4]]
    title = [x.capitalize() for x in w]
    machine = ("arm64", "x86_64", "amd64", "i386")[h % 4]
    made = {
        "build": [f"{title[0]}{title[1]}{h % 20}-{h % 5}_Build{title[2]}{h % 30}{'ABCDEFG'[h % 7]}{h % 1000}{'abcdef'[h % 6]}"],
        "dated": [f"20{h % 30:02}-{h % 12 + 1:02}-{h % 28 + 1:02}T{h % 24:02}-{h // 7 % 60:02}-{h // 11 % 60:02}Z_{w[0]}_v{h % 10}"],
        "package": [f"lib{w[0]}-{w[1]}{h % 9}-{machine}-{w[2]}_{h % 20}", f"{w[0]}-{w[1]}_{h % 40}-{h % 9}{w[2]}{h % 7}_all"],
        "pod": [f"{w[0]}-{w[1]}-{ends[:9]}-{ends[9:14]}"],
        "check": [f"sha256sum-{w[0].upper()}-mk{h % 9}-r{h % 20}", f"{w[0]}{1 << h % 12}-{w[1].upper()}-{w[2]}{h % 100}-r{h % 9}"],
    }
    return {kind: [x for x in names if len(x) >= SHORTEST] for kind, names in made.items()}


def _is_held(text: str) -> bool:
    return zlib.crc32(text.encode()) // 7 % HELD_OUT == 0


def labelled_steps(docs: DataFrame) -> DataFrame:
    """(label, step, n): character steps of the labelled samples, over all rows of ``docs(text)`` that aren't held out.

    Label 1, random: the values that the fixed patterns find, and random strings of several alphabets. Label 0, ordinary: the
    words of texts without such a value as they are (slugs, paths and snake case have the same steps), in camel case, in
    upper case, and with numbers. Null texts give nothing, rows that repeat count again, an empty table gives no rows.
    Each task sums its rows, so at most 2 x 62 x 62 rows a task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N * N), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                plain, others, made = [], [], []
                for t in texts[a:b]:
                    found = base_spans(t)
                    if found:
                        others += [f[3].encode() for f in found]
                    elif t and not _is_held(t):
                        plain.append(t)
                        made.append(numbered(t, t[:200].split()))
                        others += random_samples(t)
                data = "\n".join(plain).encode()
                total[1] += _steps(b" ".join(others))
                for form in (data, camel(data), data.upper(), "\n".join(made).encode()):
                    total[0] += _steps(form)
        label, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(total[label, step])], names=["label", "step", "n"])

    return docs.select("text").mapInArrow(run, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))


#: Kinds of held-out samples: names made like the training ones, names of other kinds, random strings by alphabet.
ORDINARY, OTHERS, RANDOM = "identifiers", ("build", "dated", "package", "pod", "check"), ("base62", "base62 other", "base64", "base36", "base32")


def held_out_rates(docs: DataFrame, models: MarkovModels, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, bin, n): held-out names of each kind and random strings of 20 to 40 characters, counted by the bin of
    their deciding rate; at most 11 x 402 rows. Null texts and texts without a word give nothing."""
    kinds = [ORDINARY, *OTHERS, *RANDOM]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kinds), len(RATES) + 1), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and _is_held(t) and not base_spans(t):
                    n = 20 + zlib.crc32(t.encode()) % 21
                    samples = {ORDINARY: identifiers(t)} | held_kinds(t) | {k: [x[:n].decode()] for k, x in zip(RANDOM, random_samples(t), strict=False)}
                    for kind, values in samples.items():
                        rates = [models.top_rate(v, threshold) for v in values]
                        np.add.at(total[kinds.index(kind)], np.searchsorted(RATES, rates), 1)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([kinds[k] for k in kind], pa.string()), pa.array(at.astype(np.int32)), pa.array(total[kind, at])], names=["kind", "bin", "n"])

    return docs.select("text").mapInArrow(run, "kind string, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n"))


def fit(steps: DataFrame) -> MarkovModels:
    """Models from rows (label, step, n), at most 2 x 62 x 62 of them; a step not seen counts half a time."""
    counts = np.zeros((2, N * N))
    for r in steps.collect():
        counts[r["label"], r["step"]] = r["n"]
    return MarkovModels(_log_steps(counts[1]) - _log_steps(counts[0]))


def with_level(models: MarkovModels, rates: DataFrame, false_share: float = FALSE_SHARE, kind_share: float = KIND_SHARE) -> MarkovModels:
    """The models with the least level >= 0 that at most ``false_share`` of the held-out identifiers and ``kind_share`` of each other kind of names
    exceed; without any, 0."""
    counts: dict[str, np.ndarray] = {}
    for r in rates.collect():
        counts.setdefault(r["kind"], np.zeros(len(RATES) + 1))[r["bin"]] = r["n"]
    # share of each kind at or above a bin's lower edge
    above = {kind: np.cumsum(n[::-1])[::-1] / n.sum() for kind, n in counts.items()}
    fits = RATES >= 0
    for kind, share in above.items():
        if kind not in RANDOM:
            fits &= share[1:] <= (false_share if kind == ORDINARY else kind_share)
    at = int(np.flatnonzero(fits)[0]) if fits.any() else len(RATES) - 1
    return replace(models, level=float(RATES[at]), found={kind: float(share[at + 1]) for kind, share in sorted(above.items())})


def train(docs: DataFrame) -> MarkovModels:
    """Models of the corpus's labelled samples, with the level that held-out ones give."""
    models = fit(labelled_steps(docs))
    return with_level(models, held_out_rates(docs, models))


def find(text: str, models: MarkovModels, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, and of what looks random in the long runs outside them."""
    spans = [s[:3] for s in base_spans(text)]
    extra = []
    for m in LONG_RUN.finditer(text):
        at, touching = m.start(), [s for s in spans if s[0] < m.end() and m.start() < s[2]]
        for a, _, b in [*touching, (m.end(), 3, m.end())]:
            rest = LONG_RUN.fullmatch(text, at, a) if a > at else None
            if rest and models.random(rest[0], threshold):
                extra.append((at, 3, a))
            elif rest:
                extra += [(at + x, 3, at + y) for x, y in models.stretches(rest[0], threshold)]
            at = max(at, b)
    return sorted([*spans, *extra])


def scan(docs: DataFrame, models: MarkovModels, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row's whole text; null: ''.

    Null ids stay null, rows that repeat are scanned each for itself, spans that start together go by kind, an empty
    table gives no rows.
    """
    say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                spans = find(t or "", models, threshold)
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlaps joined, as <kind>."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document; nulls and repeats as in :func:`scan`."""
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked; n_chars follows the text. Null texts stay null, all rows and columns stay."""
    models = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else mask(t, find(t, models)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
