"""BPE encoding and decoding with a contiguous rank array per short word.

A word's parts and the rank of each adjacent pair (with the merged id in its low bits) lie in two flat lists; the smallest
rank is found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed.  Words of over ``LONG`` parts take a heap with the
same order of merges (smallest rank, then leftmost), since scans would be quadratic there.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
import unicodedata

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import tidy

LONG = 256
_CACHE_ENTRIES = 100_000  # of each half
_NONE = 1 << 60
_ID = 24  # low bits of a rank, which hold the merged id
#: The characters with the Unicode property White_Space, as a regex class.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = regex.compile(f"[{_SPACES}]+")
_NOT_SPACE = regex.compile("[\x1c-\x1f]")  # str.split() breaks there, White_Space doesn't
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def merge_word(parts: list[int], ranks: dict[tuple[int, int], int], ids: list[int]) -> list[int]:
    """Ids of a word given as first ids; ``ranks`` gives rank << _ID | merged id of a pair, ``ids`` the one object of each id."""
    if len(parts) > LONG:
        return _merge_long(parts, ranks, ids)
    rank, low_bits = ranks.get, (1 << _ID) - 1
    near = [*map(rank, zip(parts, parts[1:]), itertools.repeat(_NONE))]
    while near:
        low = min(near)
        if low == _NONE:
            break
        i = near.index(low)
        parts[i] = new = ids[low & low_bits]
        del parts[i + 1], near[i]
        if i < len(near):
            near[i] = rank((new, parts[i + 1]), _NONE)
        if i:
            near[i - 1] = rank((parts[i - 1], new), _NONE)
    return parts


def _merge_long(parts: list[int], ranks: dict[tuple[int, int], int], ids: list[int]) -> list[int]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = ids[r & ((1 << _ID) - 1)], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer's JSON text (never trained here)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_ids = set(self.special.values())
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids = list(range(1 + max(self.vocab.values(), default=0)))
        at = lambda t: self.ids[self.vocab[t]]
        self.ranks = {(at(a), at(b)): rank << _ID | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [at(c) for c in letters]
        self.last = [at(c + self.suffix) for c in letters]
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()

    def _keep(self, key: str, found: tuple[list[int], int, str, str]) -> tuple[list[int], int, str, str]:
        """Caches an entry.  When the young half is full it becomes the old one, whose entries go unless used meanwhile."""
        if len(key) <= 64:  # so that the entries are some 100 MB at most
            if len(self._young) >= _CACHE_ENTRIES:
                self._young, self._old = {}, self._young
            self._young[key] = found
        return found

    def _word(self, word: str) -> tuple[list[int], int, str, str]:
        """The entry of a word in lower case; an ASCII word is a chunk too, others have a key that is none."""
        key = word if word.isascii() else " " + word
        if found := self._young.get(key):
            return found
        if not (found := self._old.get(key)):
            raw = word.encode("utf-8", "surrogatepass")
            ids = merge_word([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.ranks, self.ids)
            found = ids, len(ids), " ".join(map(str, ids)), self.decode(ids)
        return self._keep(key, found)

    def _chunk(self, chunk: str) -> tuple[list[int], int, str, str]:
        """Ids, their number, the ids in decimal, and the decoded tokens of text without white space or special tokens."""
        if found := self._old.get(chunk):
            return self._keep(chunk, found)
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                found = self._word(text)
                return found if text == chunk else self._keep(chunk, found)
        else:
            text = unicodedata.normalize("NFC", chunk)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        words = [self._word(w) for w in _WORD.findall(text)]
        if len(words) == 1:
            return self._keep(chunk, words[0])
        ids = [i for w in words for i in w[0]]
        return self._keep(chunk, (ids, len(ids), " ".join([w[2] for w in words]), " ".join([w[3] for w in words])))

    def pieces(self, text: str) -> list[tuple[list[int], int, str, str]]:
        """The text's chunks between white space, encoded; chunks without a token are left out."""
        if self.special and "<|" in text or self._split_special and any(s in text for s in self.special):
            out = []
            for k, piece in enumerate(self._split_special.split(text)):
                if k % 2:
                    i = self.special[piece]
                    out.append(([i], 1, str(i), self.tokens[i]))
                elif piece:
                    out += self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[list[int], int, str, str]]:
        chunks = text.split() if not _NOT_SPACE.search(text) else [c for c in _SPACE_RUN.split(text) if c]
        return [p for c in chunks if (p := self._young.get(c) or self._chunk(c))[1]]

    def forget(self) -> None:
        """Drops the chunks and words encoded so far, which a worker would keep after its task."""
        self._young, self._old = {}, {}

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in p[0]]

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        """Tokens joined by one space (the vocabulary file names no decoder); unknown ids are left out."""
        known = self.tokens
        return " ".join([known[i] for i in ids if i in known and not (skip_special_tokens and i in self.special_ids)])


#: Output columns and their types.
OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_DDL = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


_PIECE = 1 << 20


def _small(batch: pa.RecordBatch):
    """Slices of a batch of about _PIECE characters of text (one row at least): ids and tokens take many times a text's bytes."""
    ends = pa.compute.cumulative_sum(pa.compute.utf8_length(batch.column("text")).cast(pa.int64())).to_pylist()
    at, base = 0, 0
    for k, end in enumerate(ends):
        if end - base >= _PIECE or k == len(ends) - 1:
            yield batch.slice(at, k + 1 - at)
            at, base = k + 1, end


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes whole texts with the vocabulary at path ``tokenizer`` and decodes the ids again.

    ``keep`` names columns that pass through; the outputs (see ``OUTPUTS``) are added.  A null text counts as empty: no
    ids, n_tokens 0, decoded ''.  Strings of special tokens in a text become these tokens.  Rows map one to one, so
    repeated rows and ties stay as they are and an empty table gives an empty result.  One pass without a shuffle; the
    vocabulary file (read by the driver, about 2 MB) is broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ddl = ", ".join([*[f"{n} {source.schema[n].dataType.simpleString()}" for n in names], *[f"{o} {_DDL[o]}" for o in outputs]])

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    @tidy
    def run(batches):
        bpe = WordBpe(spec.value)  # a tenth of a second; kept after the task it would lie in idle workers
        gc.disable()  # nothing here makes cycles, and collections would go through the cache again and again
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()

    def encoded(bpe, batches):
        makers = {
            "ids": lambda p: [i for x in p for i in x[0]],
            "n_tokens": lambda p: sum([x[1] for x in p]),
            "ids_sha256": lambda p: digest(" ".join([x[2] for x in p])),
            "decoded": lambda p: " ".join([x[3] for x in p]),
            "decoded_sha256": lambda p: digest(" ".join([x[3] for x in p])),
        }
        wanted = [makers[o] for o in outputs]
        for batch in (part for whole in batches for part in _small(whole)):
            rows: list[list] = [[] for _ in outputs]
            for value in batch.column("text"):
                p = bpe.pieces(value.as_py())
                for out, make in zip(rows, wanted):
                    out.append(make(p))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(r, OUTPUTS[o]) for r, o in zip(rows, outputs)]], [*names, *outputs])

    return source.mapInArrow(run, ddl).withColumnsRenamed(dict(zip(names, keep)))
