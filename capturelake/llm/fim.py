"""Fill-in-middle: documents cut in three and put together in another order, cut places found by parallel automaton scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.automata import Automaton, Lanes, both, characters, marks, words
from capturelake.llm.common import documents
from capturelake.llm.tokens import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = {"chars": characters, "words": words}
#: Texts of more bytes are cut into chunks of so many, which are scanned by other tasks.
CHUNK = 1 << 16
#: Of 100 documents, those that stay plain, and those of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def automaton(unit: str = "chars") -> Automaton:
    """Counter 0: units at their first byte. Counter 1: marks, which a text to be cut may not have."""
    return both(UNITS[unit](), marks((PREFIX, SUFFIX, MIDDLE)))


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers under 2**32 from the sha256 of seed, colon and decimal doc_id. A null id counts as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and its offsets, nulls empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def _small_batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named binary column has about a million bytes in each."""
    for batch in batches:
        column = batch.column(name)
        for a, b in slices([b"" if v is None else memoryview(v.as_buffer()) for v in column], 1_000_000):
            yield batch.slice(a, b - a)


def _functions(ends: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Columns ends, units, marks: arrays with one number for each start state."""
    n, states = ends.shape
    at = pa.array(np.arange(0, (n + 1) * states, states, dtype=np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x.reshape(-1).astype(np.int64))) for x in (ends, *counts)]


FUNCTION = "ends array<long>, units array<long>, marks array<long>"


def chunk_functions(chunks: DataFrame, unit: str = "chars") -> DataFrame:
    """(key, chunk_no, ends, units, marks) of chunks (key, chunk_no, bytes): for each state in which the chunk may be entered, the
    state at its end, the units that begin and the marks that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit)
        for batch in _small_batches(batches, "bytes"):
            data, offsets = _bytes(batch.column("bytes"))
            found = Lanes(machine, data, offsets[:-1], offsets[1:]).functions()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk_no"), *_functions(*found)], names=["key", "chunk_no", "ends", "units", "marks"])

    return chunks.select("key", "chunk_no", "bytes").mapInArrow(run, f"key string, chunk_no long, {FUNCTION}")


def entries(functions: DataFrame) -> DataFrame:
    """(key, chunk_no, entry, before, has, n, n_marks): for each chunk the state in which it is entered, the units before it and in it, and the
    document's totals. A document's functions are a few numbers for each 64 KiB, at most 32,768 of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_no")
        ends, units, found = (np.array(table[c].to_pylist(), np.int64) for c in ("ends", "units", "marks"))
        state, before, seen, rows = 0, 0, 0, []
        for e, u, m in zip(ends, units, found, strict=True):
            rows.append((state, before, int(u[state])))
            before, seen, state = before + int(u[state]), seen + int(m[state]), int(e[state])
        entry, passed, has = (pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True))
        total = lambda v: pa.array(np.full(len(rows), v, np.int64))
        return pa.table([table["key"], table["chunk_no"], entry, passed, has, total(before), total(seen)], names=["key", "chunk_no", "entry", "before", "has", "n", "n_marks"])

    return functions.groupBy("key").applyInArrow(run, "key string, chunk_no long, entry long, before long, has long, n long, n_marks long")


CUT = "struct<chunk_no:bigint,entry:bigint,rest:bigint>"
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
TEXT, DIGESTS = OUT + "output string", OUT + "output_sha256 string, restored_sha256 string"


def _forms(n: np.ndarray, marked: np.ndarray, h3: np.ndarray, h4: np.ndarray, plain: int, suffix_first: int) -> np.ndarray:
    out = np.where(h4 % 100 < suffix_first, "spm", "psm").astype(object)
    out[(n == 0) | (marked > 0) | (h3 % 100 >= 100 - plain)] = "plain"
    return out


def rebuilt(form: str, output: bytes) -> bytes:
    """The text again, from the output and its form. A cut text has no mark, and no end of it with a mark's head makes one, so the first of each mark
    is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    opens, second = (p, s) if form == "psm" else (s, p)
    first, rest = output[len(opens) :].split(second, 1)
    other, middle = rest.split(m, 1)
    return b"".join((first, middle, other) if form == "psm" else (other, middle, first))


def _assembled(digests: bool, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n, form, low, high, at_low, at_high) -> pa.RecordBatch:
    """The texts in their order of parts; low and high are cut places in units, at_low and at_high in bytes of ``data``."""
    raw, out = data.tobytes(), []
    for i, kind in enumerate(form):
        a, b, c, d = int(offsets[i]), int(at_low[i]), int(at_high[i]), int(offsets[i + 1])
        if kind == "plain":
            out.append(raw[a:d])
        elif kind == "psm":
            out.append(b"".join((PREFIX.encode(), raw[a:b], SUFFIX.encode(), raw[c:d], MIDDLE.encode(), raw[b:c])))
        else:
            out.append(b"".join((SUFFIX.encode(), raw[c:d], PREFIX.encode(), raw[a:b], MIDDLE.encode(), raw[b:c])))
    parts = [pa.array(low, pa.int64(), mask=form == "plain"), pa.array(high - low, pa.int64(), mask=form == "plain")]
    if digests:
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        last = {"output_sha256": sha(out), "restored_sha256": sha(map(rebuilt, form, out))}
    else:
        last = {"output": pa.array(out, pa.binary()).cast(pa.string())}
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *parts, *last.values()], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *last])


def _h(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]


def _in_place(rows: DataFrame, unit: str, plain: int, suffix_first: int, digests: bool = False) -> DataFrame:
    """Texts of one chunk: scanned, cut and put together where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit)
        for batch in _small_batches(batches, "bytes"):
            data, offsets = _bytes(batch.column("bytes"))
            lanes = Lanes(machine, data, offsets[:-1], offsets[1:])
            _, (units, found) = lanes.functions()
            n, (h1, h2, h3, h4) = units[:, 0], _h(batch)
            low, high = (f(h1 % (n + 1), h2 % (n + 1)) for f in (np.minimum, np.maximum))
            form, all_rows, start = _forms(n, found[:, 0], h3, h4, plain, suffix_first), np.arange(len(n)), np.zeros(len(n), np.int64)
            at = [np.where(c == 0, offsets[:-1], lanes.place(all_rows, start, c)) for c in (low, high)]
            yield _assembled(digests, batch.column("doc_id"), data, offsets, n, form, low, high, *at)

    return rows.select("doc_id", "bytes", "h1", "h2", "h3", "h4").mapInArrow(run, DIGESTS if digests else TEXT)


def _across_tasks(rows: DataFrame, unit: str, chunk: int, plain: int, suffix_first: int, digests: bool = False) -> DataFrame:
    """Texts of several chunks: these are dealt to all tasks and scanned there; the functions are composed, and each cut is then
    sought in the one chunk that has it, entered in its true state."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("bytes"), strict=True):
                raw = value.as_buffer()
                for first in range(0, raw.size, chunk * 64):
                    parts = [raw[p : p + chunk].to_pybytes() for p in range(first, min(raw.size, first + chunk * 64), chunk)]
                    numbers = np.arange(len(parts)) + first // chunk
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], names=["key", "chunk_no", "bytes"])

    # rows that repeat an id and a text are one document here; each of them gets its cuts
    keyed = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("bytes", 256)))
    chunks = keyed.select("key", "bytes").mapInArrow(split, "key string, chunk_no long, bytes binary")
    functions = chunk_functions(chunks.repartition("key", "chunk_no"), unit)
    found = entries(functions.groupBy("key", "chunk_no").agg(*[F.first(c).alias(c) for c in ("ends", "units", "marks")]))
    hashes = keyed.select("key", "h1", "h2").distinct()
    lowest, highest = (f(*[F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]) for f in (F.least, F.greatest))
    placed = found.join(hashes, "key").withColumns({"low": lowest, "high": highest})

    def here(cut: str) -> Column:
        """The chunk in which unit number ``cut`` begins, or the last one for a cut at the end."""
        inside = (F.col(cut) >= F.col("before")) & (F.col(cut) < F.col("before") + F.col("has"))
        return F.max(F.when(inside, F.struct("chunk_no", "entry", (F.col(cut) - F.col("before")).alias("rest"))))

    cuts = placed.groupBy("key").agg(here("low").alias("in_low"), here("high").alias("in_high"), *[F.first(c).alias(c) for c in ("n", "n_marks", "low", "high")])
    cuts = cuts.withColumns({c: F.col(c).cast(CUT) for c in ("in_low", "in_high")})

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit)
        for batch in _small_batches(batches, "bytes"):
            data, offsets = _bytes(batch.column("bytes"))
            n, marked, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "n_marks", "low", "high"))
            _, _, h3, h4 = _h(batch)
            at = []
            for cut, name in ((low, "in_low"), (high, "in_high")):
                where = batch.column(name).to_pylist()
                place = offsets[1:].copy()
                has = np.array([i for i, w in enumerate(where) if w is not None], np.int64)
                first = np.array([offsets[i] + where[i]["chunk_no"] * chunk for i in has], np.int64)
                lanes = Lanes(machine, data, first, np.minimum(first + chunk, offsets[1:][has]))
                place[has] = lanes.place(np.arange(len(has)), np.array([where[i]["entry"] for i in has], np.int64), np.array([where[i]["rest"] for i in has], np.int64))
                at.append(np.where(cut == 0, offsets[:-1], place))
            yield _assembled(digests, batch.column("doc_id"), data, offsets, n, _forms(n, marked, h3, h4, plain, suffix_first), low, high, *at)

    wanted = ["doc_id", "bytes", "h1", "h2", "h3", "h4", "n", "n_marks", "low", "high", "in_low", "in_high"]
    return keyed.join(cuts, "key").select(*[keyed[c] if c in ("h1", "h2") else c for c in wanted]).mapInArrow(assemble, DIGESTS if digests else TEXT)


def fill_in_middle(docs: DataFrame, unit: str = "chars", seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK, digests: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs(doc_id, text)``.

    A text has n units (``unit``: 'chars', code points, or 'words', each with the white space after it). Two numbers drawn by
    ``seed`` and doc_id (:func:`draws`), each from 0 to n, part it into prefix, middle and suffix; their units are
    ``prefix_chars`` and ``middle_chars``. ``output`` is the text itself (form 'plain'), or prefix, suffix, middle ('psm'), or suffix, prefix, middle
    ('spm'), each after its mark. With ``digests`` the sha256 of it and of the text rebuilt from it (:func:`rebuilt`) come in its place. Texts without units, with a mark, and ``plain`` of 100 others stay plain, with null parts.

    The cut places come from a byte automaton that counts units and marks. A text of up to ``chunk`` bytes is scanned in its task,
    in lanes of 256 bytes; a longer one is dealt out in chunks to all tasks. Each lane and chunk gives a function from
    the state at its start to the state at its end and the counts; composing these gives the true state at each start.

    A null text is empty, a null id counts as the text 'null' in the draw, rows that repeat give the same row again, an empty table gives no rows,
    other columns are not read.
    """
    names = ["h1", "h2", "h3", "h4"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumns(dict(zip(names, draws(F.col("doc_id"), seed), strict=True)))
    short = _in_place(rows.where(F.octet_length("bytes") <= chunk), unit, plain, suffix_first, digests)
    return short.unionByName(_across_tasks(rows.where(F.octet_length("bytes") > chunk), unit, chunk, plain, suffix_first, digests))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut over code points, with the digests of its output and of the text rebuilt from it; nulls, empties, repeats as in
    :func:`fill_in_middle`."""
    return fill_in_middle(documents(spark, sf_dir), digests=True)


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
