"""Byte-level BPE: every word is merged by a segment tree over the ranks of its adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.llm.common import free_name, text_groups, without

#: words a task remembers; beyond it the memory starts anew
REMEMBERED = 150_000
#: cells of the trees that are merged side by side
CELLS = 1 << 21
_NONE = np.int64(1) << np.int64(62)
#: how a byte-level vocabulary divides text: contractions, letters, digits, the rest, white space
_WHITE = r"\t-\r\x20\x85\xa0"
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WHITE + r"\p{L}\p{N}]+|[" + _WHITE + r"]+(?![^" + _WHITE + r"])|[" + _WHITE + r"]+"
)
#: beyond these letters classes depend on the Unicode version; there the library's own division is used
_FAR = regex.compile("[^\x00-ɏ]")


def _byte_signs() -> list[str]:
    """The sign a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    signs, extra = [], 0
    for b in range(256):
        if b in plain:
            signs.append(chr(b))
        else:
            signs.append(chr(256 + extra))
            extra += 1
    return signs


class ByteBpe:
    """A tokenizer file's vocabulary, encoding many words at once."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        self.text = text
        signs = _byte_signs()
        self.first = np.array([vocab[s] for s in signs], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        ranks = np.arange(len(keys), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        back = {s: i for i, s in enumerate(signs)}
        self.token = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE >> np.int64(32))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words, all of at most the same power of two of bytes, merged side by side.

        Each row is a segment tree whose leaf i holds (rank of the pair that begins at i, i); the
        minimum at the root is the leftmost pair of the lowest rank. A merge changes three leaves
        and the nodes above them, until no root holds a pair.
        """
        n = len(words)
        lengths = np.array([len(w) for w in words])
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        sym = np.zeros((n, width), dtype=np.int64)
        sym[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        has_pair = place[:-1] < lengths[:, None] - 1
        leaves = tree[:, width : 2 * width - 1]
        ranks = self.pair_ranks(sym[:, :-1][has_pair], sym[:, 1:][has_pair])
        leaves[has_pair] = np.minimum(ranks << np.int64(32) | np.broadcast_to(place[:-1], has_pair.shape)[has_pair], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.minimum(place + 1, width - 1) * np.ones((n, 1), np.int64)
        after[place + 1 >= lengths[:, None]] = -1
        before = np.broadcast_to(place - 1, (n, width)).copy()
        alive = place < lengths[:, None]
        flat, sym1, after1, before1, alive1 = tree.ravel(), sym.ravel(), after.ravel(), before.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at, base, top = root & np.int64((1 << 32) - 1), rows * width, rows * 2 * width
            gone = after1[base + at]
            sym1[base + at] = self.made[root >> np.int64(32)]
            alive1[base + gone] = False
            then, prior = after1[base + gone], before1[base + at]
            after1[base + at] = then
            some = then >= 0
            before1[(base + then)[some]] = at[some]
            flat[top + width + gone] = _NONE
            right = np.full(len(rows), _NONE)
            right[some] = np.minimum(self.pair_ranks(sym1[(base + at)[some]], sym1[(base + then)[some]]) << np.int64(32) | at[some], _NONE)
            flat[top + width + at] = right
            led = prior >= 0
            left = np.minimum(self.pair_ranks(sym1[(base + prior)[led]], sym1[(base + at)[led]]) << np.int64(32) | prior[led], _NONE)
            flat[(top + width + prior)[led]] = left
            for leaf, who in ((at, slice(None)), (gone, slice(None)), (prior, led)):
                node, root_at = (leaf[who] + width) >> 1, top[who]
                while node.size and node[0] >= 1:
                    flat[root_at + node] = np.minimum(flat[root_at + 2 * node], flat[root_at + 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        ends = np.cumsum(alive.sum(axis=1))
        return np.split(sym[alive], ends[:-1])

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words of like length are merged together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.array([max(0, len(w) - 1).bit_length() for w in words], dtype=np.int64)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            step = max(1, CELLS >> (int(size) + 1))
            for i in range(0, len(which), step):
                part = which[i : i + step]
                for k, ids in zip(part, self.merge([words[k] for k in part])):
                    out[k] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """A text between special tokens, divided into words."""
        if not text:
            return []
        if not _FAR.search(text):
            return _PIECES.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.text).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]


class Codec:
    """Encodes and decodes whole texts, remembering a bounded number of words."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _learn(self, texts: list[list[str]]) -> None:
        new = list({p for t in texts for p in t if p not in self.known})
        ids = self.bpe.encode_words([p.encode() for p in new])
        for piece, i in zip(new, ids):
            one = i.tolist()
            self.known[piece] = (",".join(map(str, one)), len(one), b"".join([self.bpe.token[t] for t in one]))

    def both(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Per text: its ids in decimal joined by commas, their number, the bytes they stand for."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        cut = [self.bpe.specials.split(t) if self.bpe.specials else [t] for t in texts]
        parts = [[p if k % 2 else self.bpe.pieces(p) for k, p in enumerate(c)] for c in cut]
        self._learn([p for ps in parts for p in ps if isinstance(p, list)])
        for ps in parts:
            found: list[tuple[str, int, bytes]] = []
            for p in ps:
                if isinstance(p, list):
                    found += [self.known[w] for w in p]
                else:
                    i = self.bpe.added[p]
                    found.append((str(i), 1, self.bpe.token[i]))
            yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found])


@lru_cache(maxsize=2)
def codec(text: str) -> Codec:
    """One codec for a worker process, whatever the number of its tasks."""
    return Codec(ByteBpe(text))


def _added(docs: DataFrame, tokenizer_file: str, text: str, make, kind: str) -> DataFrame:
    """`docs` with the fields of `kind`, which `make` gets from each text's ids, their number and bytes."""
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    names = [field.split(":")[0] for field in kind.split(",")]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = codec(model.value).both
        for column in parts:
            rows = [make(*one) for texts in text_groups(column) for one in both(texts)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], type=_ARROW[names[k]]) for k in range(len(names))], names=names)

    kept = without(docs, *names)
    new = free_name(kept, "_t")
    added = kept.withColumn(new, F.arrow_udf(run, f"struct<{kind}>")(F.col(f"`{text}`")))
    return added.select(*[F.col(f"`{c}`") for c in kept.columns], f"{new}.*")


_ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def tokenized(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (the whole text's token ids), `n_tokens` and `decoded` (the text the ids give back).

    Ids are those of the tokenizers library for a byte-level BPE file with add_special_tokens=False:
    strings of special tokens in a text become those tokens. Null texts count as empty: no ids, empty
    text. Bytes that are no UTF-8 decode to U+FFFD. Columns with these names are replaced.
    """

    def make(ids: str, n: int, raw: bytes) -> tuple:
        return [int(i) for i in ids.split(",")] if n else [], n, raw.decode("utf-8", "replace")

    return _added(docs, tokenizer_file, text, make, "ids:array<int>,n_tokens:bigint,decoded:string")


def token_digests(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """Like `tokenized`, with SHA-256 digests in place of ids and text, so that no id array leaves its task.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    """

    def make(ids: str, n: int, raw: bytes) -> tuple:
        text = raw.decode("utf-8", "replace").encode()
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    return _added(docs, tokenizer_file, text, make, "n_tokens:bigint,ids_sha256:string,decoded_sha256:string")
