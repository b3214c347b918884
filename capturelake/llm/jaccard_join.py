"""N-gram Jaccard join: prefix index lists, skipped by blocks of length and position, and answers derived from those of a list's leader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import CLEANUP, components, cut, documents, scratch_dir
from capturelake.llm.hashing import mix, shingles
from capturelake.llm.near_dup import SLICE, _one_id, fingerprints
from capturelake.llm.tokens import slices

WIDTH = 3
#: What tells sets apart: number of elements and two sums of their hashes.
SAME = ["n", "print_a", "print_b"]
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: 2**BITS counters say how common a shingle is; they are broadcast as one byte each, 4 MiB whatever the input.
BITS = 22
BLOCK = 1 << 16
#: A shingle that about so many rows have is dealt to one more task for each so many.
HOT = 4096
PARITY = 1024
#: Lists of up to so many sets are looked through for entries that can link while they are built.
SHORT = 8


def elements(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, hash) of the distinct shingles of the texts in lower case (A-Z alone), sorted."""
    index, value = shingles([t.encode().lower() for t in texts], width)
    _sort_within(index, value, len(texts))
    new = np.ones(len(index), bool)
    new[1:] = (value[1:] != value[:-1]) | (index[1:] != index[:-1])
    return index[new], value[new]


def _sort_within(index: np.ndarray, value: np.ndarray, m: int) -> None:
    """Sorts the values of each index, which rises, in place."""
    ends = np.searchsorted(index, np.arange(m + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        value[a:b].sort()


def parities(index: np.ndarray, value: np.ndarray, m: int) -> pa.Array:
    """For each text 16 longs: bit b says whether an odd number of its elements has the hash b by 1,024. Two texts' sets differ in at least as many
    elements as their bits."""
    odd = np.bincount(index * PARITY + (value % np.uint64(PARITY)).astype(np.int64), minlength=m * PARITY).astype(np.uint8) & 1
    longs = np.packbits(odd).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) + 1, PARITY // 64, dtype=np.int32)), pa.array(longs))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts, SLICE):
            yield batch.column(0).slice(a, b - a), texts[a:b]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def surveyed(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Two kinds of rows from one pass: (doc_id, n, print_a, print_b, parity) of each row's set, and (block, counts): for 65,536 counters in a row
    how many of a task's sets have a shingle of theirs."""
    names = ["doc_id", *SAME, "parity", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for ids, texts in _texts(batches):
            m = len(texts)
            index, value = elements(texts, width)
            np.add.at(seen, (value >> np.uint64(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(index, minlength=m)), *fingerprints(index, value, m), parities(index, value, m), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        for block, part in enumerate(seen.reshape(-1, min(BLOCK, 1 << bits))):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.list_(pa.int64())), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)

    return _rows(docs).mapInArrow(run, "doc_id long, n long, print_a long, print_b long, parity array<long>, block int, counts binary")


def commonness(survey: DataFrame, bits: int) -> np.ndarray:
    """For each counter eight times the binary logarithm of its total plus one, a byte: 2**bits bytes, however large the input is."""

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.int64) for c in table["counts"])
        return pa.table({"block": table["block"].slice(0, 1), "level": pa.array([np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8).tobytes()], pa.binary())})

    levels = np.zeros(1 << bits, np.uint8)
    for block, level in survey.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(total, "block int, level binary").collect():
        levels[block * BLOCK : block * BLOCK + len(level)] = np.frombuffer(level, np.uint8)
    return levels


def prefix_length(n, percent: int):
    """Two similar sets of n and any other size have one of the n's first so many elements in common, in an order that all sets share."""
    return n - -(-n * percent // 100) + 1


POSTING = ["token", "salt", "pos", *SAME]


def postings(docs: DataFrame, levels, width: int, percent: int, bits: int, hot: int = HOT) -> DataFrame:
    """(token, salt, pos, n, print_a, print_b): the first elements of each set, the rarest first, with their positions.

    A token is the broadcast commonness of an element and 56 bits of its hash, and tokens are the order: elements that agree in both count as one here, which
    can only make sets meet. A set that a task has sent already is not sent again, so copies are few. The lists of a
    common token are parted by a salt that depends on the set; other tokens have salt -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, sent = levels.value, set()
        for _, texts in _texts(batches):
            m = len(texts)
            index, value = elements(texts, width)
            if not len(index):
                continue
            n = np.bincount(index, minlength=m)
            prints = [p.to_numpy() for p in fingerprints(index, value, m)]
            if len(sent) > 1_000_000:
                sent.clear()
            fresh = np.zeros(m, bool)
            for i, key in enumerate(zip(n.tolist(), *[p.tolist() for p in prints], strict=True)):
                if key[0] and key not in sent:
                    sent.add(key)
                    fresh[i] = True
            common = level[(value >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
            token = common << np.uint64(56) | value >> np.uint64(8)
            _sort_within(index, token, m)
            pos = np.arange(len(index)) - np.searchsorted(index, index)
            keep = fresh[index] & (pos < prefix_length(n, percent)[index])
            index, token, pos = index[keep], token[keep], pos[keep]
            parts = (2.0 ** ((token >> np.uint64(56)) / 8) / hot).astype(np.int64)
            salt = np.where(parts > 0, (mix(prints[0][index].view(np.uint64)) % (parts + 1).astype(np.uint64)).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(n[index]), *[pa.array(p[index]) for p in prints]], names=POSTING)

    return _rows(docs).mapInArrow(run, "token long, salt int, pos int, n long, print_a long, print_b long")


class Lists:
    """Index lists out of sorted postings, a batch at a time: each entry of a list with two sets or more, beside the list's leader, its
    first. Only the leader and the last row are kept between batches.

    With ``percent``, entries of a list of up to SHORT sets that no other entry can link with, by lengths and positions, are left
    out; most lists that two texts share by chance go this way.
    """

    def __init__(self, percent: int | None = None):
        self.percent = percent
        self.last = self.leader = None
        self.sets = 0

    def step(self, rows: np.ndarray) -> np.ndarray:
        """rows: int64 [m, 6] in the order of POSTING, sorted. Returns [k, 10]: such rows, and pos, n and fingerprint of the leader."""
        before = np.vstack([self.last[None] if self.last is not None else np.full((1, 6), -(1 << 62)), rows[:-1]])
        opens = (rows[:, :2] != before[:, :2]).any(axis=1)
        if self.last is None:
            opens[0] = True
        new = opens | (rows[:, 3:] != before[:, 3:]).any(axis=1)
        group = np.cumsum(opens)
        first = np.flatnonzero(opens)
        leaders = np.vstack([self.leader[None] if self.leader is not None else np.zeros((1, 6), np.int64), rows[first]])
        sets = np.bincount(group, new, minlength=len(leaders)).astype(np.int64)
        waiting = self.sets == 1
        sets[0] += self.sets
        listed = (sets >= 2) | (leaders[:, 1] >= 0)
        keep = new & listed[group]
        if self.percent:
            at = np.flatnonzero(keep)
            keep[at[~self._met(rows[at], group[at], group[-1])]] = False
        out = np.hstack([rows[keep], leaders[group[keep]][:, 2:]])
        # a leader that was alone when its batch ended; the leader of a salted list never waits
        if waiting and sets[0] >= 2 and self.leader[1] < 0:
            out = np.vstack([np.hstack([self.leader, self.leader[2:]])[None], out])
        # of the last list, one set so far: it waits for a second
        self.last, self.leader, self.sets = rows[-1], leaders[-1], int(sets[-1])
        return out


    def _met(self, rows: np.ndarray, group: np.ndarray, last: int) -> np.ndarray:
        """Which rows some other of their list can link with; all of long lists, salted ones, and those that may go on in another batch."""
        sizes = np.bincount(group, minlength=last + 1)
        met = (sizes[group] > SHORT) | (group == 0) | (group == last) | (rows[:, 1] >= 0)
        for d in range(1, min(SHORT, len(rows))):
            a, b = rows[:-d], rows[d:]
            total = a[:, 3] + b[:, 3]
            need = -(-total * self.percent // (100 + self.percent))
            fits = (group[:-d] == group[d:]) & (np.minimum(a[:, 3] - a[:, 2], b[:, 3] - b[:, 2]) >= need) & (a[:, 2] + b[:, 2] <= total - 2 * need)
            met[:-d] |= fits
            met[d:] |= fits
        return met


LEADER = ["l_pos", "l_n", "l_a", "l_b"]


def index_lists(posted: DataFrame, percent: int) -> DataFrame:
    """(token, salt, pos, n, print_a, print_b, l_pos, l_n, l_a, l_b): entries of all lists of two sets or more. A list's leader has the smallest position,
    so the fewest rare elements of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(percent)
        for batch in batches:
            if batch.num_rows:
                out = lists.step(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in POSTING]))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=[*POSTING, *LEADER])

    ordered = posted.repartition("token", "salt").sortWithinPartitions(*POSTING)
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in [*POSTING, *LEADER]))


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """The elements that two linked sets of these sizes share at least."""
    return F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)


def can_link(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """What lengths and positions of a first common element allow: enough elements after it, and not too many before it."""
    need = needed(n1, n2, percent)
    return (n1 - pos1 >= need) & (n2 - pos2 >= need) & (pos1 + pos2 <= n1 + n2 - 2 * need)


def _among(ids: DataFrame, bits: int) -> np.ndarray:
    """One bit for each of 2**bits hashes: whether one of ``ids(doc_id)`` has it. 2**bits / 8 bytes, however many ids there are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_slot(batch.column(0), bits)] = True
        for block, part in enumerate(np.packbits(seen).reshape(-1, min(BLOCK, 1 << bits) // 8)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "marked"])

    def either(table: pa.Table) -> pa.Table:
        parts = np.bitwise_or.reduce([np.frombuffer(m.as_py(), np.uint8) for m in table["marked"]])
        return pa.table({"block": table["block"].slice(0, 1), "marked": pa.array([parts.tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    marks = ids.select("doc_id").mapInArrow(mark, "block int, marked binary")
    for block, marked in marks.groupBy("block").applyInArrow(either, "block int, marked binary").collect():
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(marked)] = np.frombuffer(marked, np.uint8)
    return np.unpackbits(out).astype(bool)


def _slot(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, bits: int) -> DataFrame:
    """(rep, elements) of the sets ``wanted(doc_id, n, print_a, print_b, rep)``.

    A broadcast bit table, of a size that does not depend on the input, tells most other documents from those that are wanted, so their
    texts are neither shuffled nor taken apart; the join decides.
    """
    marked = docs.sparkSession.sparkContext.broadcast(_among(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = marked.value
        for batch in batches:
            batch = batch.filter(pa.array(mine[_slot(batch.column(0), bits)]))
            for ids, texts in _texts(iter([batch])):
                m = len(texts)
                index, value = elements(texts, width)
                ends = np.searchsorted(index, np.arange(m + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends).astype(np.int64)), *fingerprints(index, value, m), sets], names=["doc_id", *SAME, "elements"])

    found = _rows(docs).mapInArrow(run, "doc_id long, n long, print_a long, print_b long, elements array<long>")
    return found.join(wanted, ["doc_id", *SAME]).groupBy("rep").agg(F.first("elements").alias("elements"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) of pairs (a, b) of set numbers."""
    left, right = (sets.select(F.col("rep").alias(c), F.col("elements").alias(e)) for c, e in (("a", "x"), ("b", "y")))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("shared"))


def may_link(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities do not say that their sets differ in too many elements."""
    x, y = (reps.select(F.col("rep").alias(r), F.col("n").alias(n), F.col("parity").alias(p)) for r, n, p in (("a", "n1", "p1"), ("b", "n2", "p2")))
    differ = F.aggregate(F.zip_with("p1", "p2", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    both = pairs.join(y, "b").join(x, "a")
    return both.where(differ <= F.col("n1") + F.col("n2") - 2 * needed(F.col("n1"), F.col("n2"), percent)).select("a", "b")


def linked(shared: Column, n1: Column, n2: Column, percent: int) -> Column:
    return shared * 100 >= (n1 + n2 - shared) * percent


def compared(pairs: DataFrame, known: DataFrame, reps: DataFrame, width: int, bits: int) -> DataFrame:
    """(a, b, n_a, n_b, shared) of the pairs, by the whole sets of those in them alone."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = cut(reps.join(both, "rep", "left_semi").select(F.col("first_id").alias("doc_id"), *SAME, "rep"))
    return cut(overlaps(pairs, stored(shingle_sets(known, wanted, width, bits))))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint. Its shuffle files go too."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/jaccard-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _numbered(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """Entries and leaders by their sets' numbers: token, salt, rep, n, pos, leader, l_n, l_pos."""
    name = reps.select("rep", *SAME)
    lead = reps.select(F.col("rep").alias("leader"), *[F.col(c).alias(x) for c, x in zip(SAME, LEADER[1:], strict=True)])
    return lists.join(name, SAME).join(lead, LEADER[1:]).select("token", "salt", "rep", "n", "pos", "leader", "l_n", "l_pos")


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): the leader with each entry that it may link, and the leaders of the parts of one salted list with the first of them."""
    stars = lists.where((F.col("rep") != F.col("leader")) & can_link(F.col("n"), F.col("pos"), F.col("l_n"), F.col("l_pos"), percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    parts = lists.where("salt >= 0 and rep = leader").select("token", "rep", "n", "pos")
    heads = parts.groupBy("token").agg(F.min(F.struct("pos", "rep", "n")).alias("h"))
    across = parts.join(heads, "token").where((F.col("rep") != F.col("h.rep")) & can_link(F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos"), percent))
    return stars.union(across.select("h.rep", "rep")).distinct()


def _open_pairs(lists: DataFrame, part: DataFrame, tested: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of lists that still hold several components: the pairs (a, b) left to be checked, and those whose link follows already.

    An entry is light if its position is at most a (1 - t) / (1 + t) share of its length; of two entries that link, one is light. So light
    entries meet the entries of the three neighbouring blocks of length, and heavy ones never meet each other. Both entries' overlaps s1,
    s2 with their list's leader, of m elements, are known: they share at most min(s1, s2) + min(n1 - s1, n2 - s2) and at least
    s1 + s2 - m, which decides most pairs.
    """
    rooted = lists.join(part, lists["rep"] == part["node"], "left").select(*[lists[c] for c in lists.columns], F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    known = tested.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "shared")
    mine = rooted.join(several, "token", "left_semi").join(known, ["leader", "rep"], "left")
    mine = mine.withColumn("shared", F.when(F.col("rep") == F.col("leader"), F.col("n")).otherwise(F.col("shared")))
    block = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)))
    mine = cut(mine.withColumns({"block": block, "light": F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)}))
    names = ["rep", "n", "pos", "root", "leader", "l_n", "shared", "light"]
    x = mine.where("light").select("token", "block", *[F.col(c).alias(f"x_{c}") for c in names])
    y = mine.select("token", F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)])).alias("block"), *[F.col(c).alias(f"y_{c}") for c in names])
    c = {f"{s}_{k}": F.col(f"{s}_{k}") for s in "xy" for k in names}
    once = ~c["y_light"] | (c["x_rep"] < c["y_rep"])
    need = needed(c["x_n"], c["y_n"], percent)
    most = F.least("x_shared", "y_shared") + F.least(c["x_n"] - c["x_shared"], c["y_n"] - c["y_shared"])
    least = c["x_shared"] + c["y_shared"] - c["x_l_n"]
    both_known = (c["x_leader"] == c["y_leader"]) & c["x_shared"].isNotNull() & c["y_shared"].isNotNull()
    fits = (c["x_root"] != c["y_root"]) & once & can_link(c["x_n"], c["x_pos"], c["y_n"], c["y_pos"], percent) & (~both_known | (most >= need))
    met = x.join(y, ["token", "block"]).where(fits)
    met = met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"), (both_known & (least >= need)).alias("sure"))
    met = cut(met.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.where("not sure").select("a", "b").join(done, ["a", "b"], "left_anti"), met.where("sure").select("a", "b")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    A row's set: the distinct shingles of ``width`` words of its whole text, A-Z in lower case; the words as one where they are fewer. Two rows
    link when 100 * intersection >= ``percent`` * union. component_id is the least doc_id that can be reached by links.

    Equal sets are one. Each set posts its rarest elements, as many as any linked partner must meet. Lists are built by one sort; a
    list's leader is compared with all its entries that length and position allow, so a list of many near copies closes after one check an
    entry. In lists that still hold several components, pairs are met by blocks of length and position (:func:`_open_pairs`), and
    what both share with the leader decides most of them; the rest are compared in full. Before any set is fetched, parities of 1,024 bits rule out most pairs that cannot
    link. No list, pair or candidate is capped, so no link
    between components is missed; links inside one are not all listed. Shingles are compared by 64-bit hashes.

    Rows that repeat a doc_id are one document, whatever their texts. Texts without words are linked with nothing, not with each other: their
    component is their own doc_id. Null ids link nothing and have a null component. An empty table gives no rows.
    """
    known = docs.where("doc_id is not null")
    survey = stored(surveyed(known, width, bits))
    rows = survey.where("block is null").select("doc_id", *SAME, "parity")
    reps = rows.where("n > 0").groupBy(*SAME).agg(F.min("doc_id").alias("first_id"), F.first("parity").alias("parity"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    rows = rows.drop("parity")
    levels = docs.sparkSession.sparkContext.broadcast(commonness(survey, bits))
    lists = stored(_numbered(stored(index_lists(postings(known, levels, width, percent, bits, hot), percent)), reps))

    first = cut(may_link(_leader_pairs(lists, percent), reps, percent))
    tested = compared(first, known, reps, width, bits)
    links = tested.where(linked(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    part = cut(components(links))

    left, sure = _open_pairs(lists, part, tested, percent)
    left = cut(may_link(left, reps, percent))
    more = compared(left, known, reps, width, bits).where(linked(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    part = cut(components(links.union(sure).union(more).union(_one_id(rows.where("n > 0"), reps))))

    rooted = reps.join(part, reps["rep"] == part["node"], "left").select(*SAME, "first_id", "root")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    named = rooted.join(least, "root", "left").select(*SAME, F.coalesce("least", "first_id").alias("component_id"))
    out = rows.join(named, SAME, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = surveyed(docs.where("doc_id is null"), width, bits).where("block is null")
    return out.unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component; nulls, empties, repeats and ties as in :func:`jaccard_components`."""
    return jaccard_components(documents(spark, sf_dir))


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 90 * (u.n + v.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
