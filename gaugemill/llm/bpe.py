"""BPE encoding and decoding by speculation and verification.

Greedy longest-match proposes the tokens of every new word. A sequence of tokens is what the merges
give if and only if each adjacent pair, merged on its own, gives that pair again; so the pairs of all new
words are looked up at once among the pairs already judged, and a pair seen for the first time is judged by
merging its characters. Only words with a pair that fails are merged exactly.

Results: null and empty texts give no tokens and an empty decoded text. Very long texts are taken in
slices of runs. Repeated rows give repeated rows. Extra columns are kept, the results follow them; a column
with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import free_name, portions, slices, texts_of
from gaugemill.llm.pieces import PieceCache, tokenizer

#: Parts kept in each of two generations: with their ids more than texts take otherwise.
CACHE = 60_000
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


class SpeculativeBpe:
    """Encoder and decoder for a tokenizers file with word ends (``end_of_word_suffix``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizer(path)  # for its normaliser and its splitting of words beyond ASCII
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.size = max(chain(self.vocab.values(), self.special.values())) + 1
        self.text = [""] * self.size
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.text[i] = token
        self.longest: dict[str, int] = {}  # of the tokens that start with these two characters
        for token in self.vocab:
            bare = token.removesuffix(self.end) or token
            self.longest[bare[:2]] = max(self.longest.get(bare[:2], 0), len(bare))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        moved = [b for b in range(256) if b not in set(kept)]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.good = np.zeros(0, np.int64)  # pair keys, sorted
        self.bad = np.zeros(0, np.int64)
        self.whole: dict[int, bool] = {}
        self.cache = PieceCache(self.encode_parts, lower=True, spaced=False, limit=CACHE)

    def merged(self, symbols: list[str]) -> list[str]:
        """The exact merges: the lowest rank first, leftmost first among equals."""
        rank, none = self.rank.get, 1 << 60
        at = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while at and (best := min(at)) < none:
            i = at.index(best)
            new = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [new]
            del at[i]
            if i:
                at[i - 1] = rank((symbols[i - 1], new), none)
            if i < len(at):
                at[i] = rank((new, symbols[i + 1]), none)
        return symbols

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def greedy(self, word: str) -> list[int] | None:
        vocab, longest, out, at, n = self.vocab.get, self.longest.get, [], 0, len(word)
        while at < n:
            for stop in range(min(n, at + longest(word[at : at + 2], 1)), at, -1):
                token = vocab(word[at:stop] + self.end if stop == n else word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
            else:
                return None
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each key left * size + right: does merging the pair's characters give the pair? (Equal halves: the token itself.)"""
        distinct, back = np.unique(keys, return_inverse=True)
        new = distinct[~np.isin(distinct, self.good, assume_unique=True) & ~np.isin(distinct, self.bad, assume_unique=True)]
        good, bad = [], []
        for key in new.tolist():
            left, right = divmod(key, self.size)
            a, b = self.text[left], self.text[right]
            last = b.endswith(self.end) and len(b) > len(self.end)
            chars = [*a, *(self.symbols(b.removesuffix(self.end)) if last else b)]
            (good if self.merged(chars) == [a, b] else bad).append(key)
        self.good, self.bad = np.union1d(self.good, np.array(good, np.int64)), np.union1d(self.bad, np.array(bad, np.int64))
        return np.isin(distinct, self.good, assume_unique=True)[back]

    def reached(self, token: int, word: str) -> bool:
        """Do its own merges give this token? Judged once for each token."""
        if token not in self.whole:
            self.whole[token] = self.merged(self.symbols(word)) == [self.text[token]]
        return self.whole[token]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words in the byte alphabet."""
        proposed = [self.greedy(w) for w in words]
        flat = np.fromiter(chain.from_iterable(p or () for p in proposed), np.int64)
        lengths = np.array([len(p or ()) for p in proposed], np.int64)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, int)
        fails = lengths == 0
        fails[word[inner[~self.compatible(flat[inner] * self.size + flat[inner + 1])]]] = True
        for i in np.flatnonzero(lengths == 1):
            fails[i] = not self.reached(int(flat[ends[i] - 1]), words[i])
        for i in np.flatnonzero(fails):
            proposed[i] = [self.vocab[s] for s in self.merged(self.symbols(words[i])) if s in self.vocab]
        return proposed

    def words(self, part: str) -> list[str]:
        """The words of a text without white space or special tokens, normalised, in the byte alphabet."""
        if part.isascii():
            found = PLAIN.findall(part.lower())
            if part.isprintable():
                return found
            return ["".join(self.shown[b] for b in w.encode()) for w in found]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def encode_parts(self, found: list[str]) -> list[bytes]:
        split = []  # for each part words, or an id as it is
        for part in found:
            if self.split_special and "<|" in part:
                split.append([y for x in self.split_special.split(part) if x for y in ([self.special[x]] if x in self.special else self.words(x))])
            else:
                split.append(self.words(part))
        distinct = list({w for ws in split for w in ws if isinstance(w, str)})
        ids = {w: array("I", i).tobytes() for w, i in zip(distinct, self.encode_words(distinct), strict=True)}
        return [b"".join(ids[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in ws) for ws in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for rows in slices(texts):
            runs = [self.cache.split(texts[i]) for i in rows]
            known = self.cache.learn(chain.from_iterable(runs))
            out += [b"".join(map(known.__getitem__, r)) for r in runs]
        return out

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens as they are written, with spaces between them."""
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, SpeculativeBpe] = {}


def loaded(path: str) -> SpeculativeBpe:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``keep_ids`` also ``ids`` (binary) and ``decoded``.

    ``path`` names the tokenizer's file, which every executor can open."""
    kept = [c for c in docs.columns if c not in {"n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_ids else ())}]
    without_text = [F.col(f"`{c}`") for c in kept if c != text or keep_ids]

    def batches(frames):
        bpe = loaded(path)
        for frame in (part for whole in frames for part in portions(whole)):
            texts = texts_of(frame.column(0))
            ids = bpe.encode(texts)
            decoded = [bpe.decode(x) for x in ids]
            new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            new += [pa.array(ids, pa.binary()), pa.array(decoded)] if keep_ids else []
            names = [*frame.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_ids else ())]
            yield pa.RecordBatch.from_arrays([*frame.columns[1:], *new], names)
        bpe.cache.forget()  # the worker stays for other stages

    schema = docs.select(*without_text).schema
    for f in ("n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(("ids binary", "decoded string") if keep_ids else ())):
        schema = schema.add(*f.split())
    return docs.select(F.col(f"`{text}`").cast("string").alias(free_name(docs, "text")), *without_text).mapInArrow(batches, schema)
