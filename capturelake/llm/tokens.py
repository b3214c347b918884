"""Token ids of whole texts by a public tokenizer, with the pieces of text seen before kept per worker."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MODEL = "byte_bpe_50k.json"
#: Pieces that one Python worker keeps; from then on new ones are encoded each time a batch has them.
KEEP_PIECES = 1_000_000
#: Pieces encoded in one call.
JOINED = 2000
#: How the byte-level vocabulary writes a space and a line's end.
SPACE_MARK, LINE_MARK = "Ġ", "Ċ"

_ENCODERS: dict[str, Encoder] = {}
#: Letters after which a full stop or comma always starts a new pre-token.
LETTERS = {chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()} | set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
MARKS = (".", ",")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)``, piece by piece.

    The byte-level pre-tokenizer always starts a new pre-token where a space follows what isn't white space,
    and the merges never pass that place, so ids of the pieces between such places, joined, are the text's ids.
    A text with white space on both sides of a space (or at an end of it) is encoded whole; so is every
    text if the file's pre-tokenizer is another one.

    Arrow splits the texts and numbers their distinct pieces, so Python sees each distinct piece of a batch once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        known = json.loads(self.tokenizer.to_str())
        before = known["pre_tokenizer"] or {}
        self.by_pieces = known["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        vocabulary = self.tokenizer.get_vocab()
        self._opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self._opens[[i for t, i in vocabulary.items() if t.startswith(SPACE_MARK)]] = True
        self._line = vocabulary.get(LINE_MARK, -1)
        # ids by piece: of the piece after a space, and of the piece as it is
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _fresh(self, pieces: list[str], spaced: bool) -> dict[str, bytes]:
        """Ids of pieces without white space. Many are encoded as one text and parted where a token opens with a space,
        or, without spaces before them, at the line ends between them."""
        out: dict[str, bytes] = {}
        size = self.dtype.itemsize
        for a in range(0, len(pieces), JOINED):
            part = pieces[a : a + JOINED]
            text = " " + " ".join(part) if spaced else "\n" + "\n".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self._opens[ids] if spaced else ids == self._line)
            if len(cuts) == len(part):
                raw = ids.tobytes()
                ends = (np.append(cuts[1:], len(ids)) * size).tolist()
                starts = (cuts * size if spaced else (cuts + 1) * size).tolist()
                out.update(zip(part, map(lambda x, y: raw[x:y], starts, ends)))
            else:
                out.update((p, self._whole(" " + p if spaced else p)) for p in part)
        return out

    def _learn(self, pieces: list[str], spaced: bool) -> dict[str, bytes]:
        """Ids of distinct pieces that aren't kept so far; what stands at a certain pre-token end is encoded once."""
        kept = self.spaced if spaced else self.bare
        new: dict[str, bytes] = {}
        heads, ended, lines, plain = set(), [], [], []
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif len(p.split()) == 1 and not p[-1].isspace() and not p[0].isspace():
                if p[-1] in MARKS and p[-2:-1] in LETTERS:
                    ended.append(p)
                    if p[:-1] not in kept:
                        heads.add(p[:-1])
                else:
                    plain.append(p)
            else:
                lines.append(p)
        heads.update(plain)
        rows = {p: p.split("\n") for p in lines}
        # single line ends between pieces are pre-tokens of their own
        parted = {p: x for p, x in rows.items() if len(x) > 1 and all(y and len(y.split()) == 1 and not y[0].isspace() and not y[-1].isspace() for y in x)}
        if parted:
            for x in parted.values():
                if x[0] not in kept:
                    heads.add(x[0])
            rest = {y for x in parted.values() for y in x[1:]} - self.bare.keys()
            bare = self._fresh(list(rest), False)
            if len(self.bare) + len(bare) <= KEEP_PIECES // 4:
                self.bare.update(bare)
        new.update(self._fresh(list(heads), spaced))
        get = lambda p: new[p] if p in new else kept[p]
        if ended:
            marks = {m: self._whole(m) for m in MARKS}
            for p in ended:
                new[p] = get(p[:-1]) + marks[p[-1]]
        line = self._bytes([self._line]) if parted else b""
        for p, x in parted.items():
            new[p] = line.join([get(x[0]), *(bare[y] if y in bare else self.bare[y] for y in x[1:])])
        for p in lines:
            if p not in parted:
                new[p] = self._whole(" " + p if spaced else p)
        if len(kept) + len(new) <= KEEP_PIECES // (1 if spaced else 4):
            kept.update(new)
        return new

    def _ids_of(self, pieces: list[str], spaced: bool) -> list[bytes]:
        found = list(map((self.spaced if spaced else self.bare).get, pieces))
        missing = [p for p, v in zip(pieces, found) if v is None]
        if missing:
            new = self._learn(list(dict.fromkeys(missing)), spaced)
            found = [new[p] if v is None else v for p, v in zip(pieces, found)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of ``dtype``."""
        if not texts or not self.by_pieces:
            return [self._whole(t) for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        first = edges[:-1]
        heads = [pieces[i] for i in at[first]]
        # an empty piece, or one that begins with white space, has white space on both sides of its space
        odd = np.array([not p or p[0].isspace() for p in pieces])
        lone = odd[at]
        lone[first] = False
        whole = np.unique(np.searchsorted(edges, np.flatnonzero(lone), side="right") - 1)
        ids = self._ids_of(["a" if o else p for p, o in zip(pieces, odd)], True) + self._ids_of(heads, False)
        at[first] = np.arange(len(pieces), len(ids))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        begin = np.cumsum(size) - size
        count = size[at]
        ends = np.cumsum(count)
        stream = flat[np.arange(ends[-1]) + np.repeat(begin[at] - (ends - count), count)]
        bounds = np.append(0, ends)[edges].tolist()
        out = [stream[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i in whole.tolist():
            out[i] = self._whole(texts[i])
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[str], chars: int = 4_000_000):
    """Ranges of ``texts`` of about so many characters, so that a batch of long ones stays small."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
