"""Tokens of a public byte-pair vocabulary: counts by array merging, and ids for packing.

Both keep what they know about a word by its hash, so that each distinct
word of a worker's batches is looked at once. The store is emptied when it
holds more than ``STORE_WORDS`` words; that only costs time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.llm import words as W
from bitmesh.llm.frames import LARGE_BATCH, prepare

VOCABULARY = "word_bpe_49k.json"
STORE_WORDS = 1_500_000
#: Words that are one pre-token, and what ends the last token of each in the vocabulary (fixed values).
PLAIN, WORD_END = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), "</w>"
_NEVER = np.iinfo(np.int64).max


class MergeCounter:
    """Counts tokens by merging all sequences in step: in every round each sequence applies its lowest-rank pair, everywhere it stands."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"].get("end_of_word_suffix") or ""
        rules = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in rules], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in rules], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        top = max(ord(s[0]) for s in vocab if len(s.removesuffix(end) if end and s != end else s) == 1) + 1
        self.inner, self.final = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for c in range(top):
            self.inner[c] = vocab.get(chr(c), -1)
            self.final[c] = vocab.get(chr(c) + end, -1)
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def merged(self, symbols: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence ``symbols[borders[i]:borders[i + 1]]``."""
        left = np.diff(borders).copy()
        seq = np.repeat(np.arange(len(left)), left)
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), _NEVER)
            rank[:-1] = np.where((self.keys[at] == pair) & (seq[:-1] == seq[1:]), self.ranks[at], _NEVER)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best < _NEVER
            if not open_.any():
                break
            hit = open_ & (rank == best)
            # of pairs that overlap, as in "aaa", the first, third and so on count
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            gone = np.r_[False, hit[:-1]]
            left -= np.bincount(seq[gone], minlength=len(left))
            stay = open_ & ~gone
            symbols, seq = symbols[stay], seq[stay]
        return left

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word is a text without blanks."""
        total = np.zeros(len(words), np.int64)
        parts, owner = words, range(len(words))
        if self.special and any("<|" in w for w in words):
            parts, owner = [], []
            for i, w in enumerate(words):
                pieces = self.special.split(w)
                total[i] += len(pieces) - 1
                parts += [p for p in pieces if p]
                owner += [i] * sum(map(bool, pieces))
        pieces: list[str] = []
        of: list[np.ndarray] = []
        owner = np.asarray(owner, np.int64)
        # words without any white space are told apart by the blanks between them; one that has some, at its edges too, is taken by itself
        plain = [i for i, w in enumerate(parts) if w.split() == [w]]
        alone = sorted(set(range(len(parts))) - set(plain))
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            text = self.normal.normalize_str("\n".join([parts[i] for i in some]))
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
            if len(blanks) != len(some) - 1 or text[:1] == " ":  # the normaliser has made or taken away blanks
                alone += some
                continue
            found = self.split.pre_tokenize_str(text)
            of.append(np.array(some)[np.searchsorted(blanks, [p[1][0] for p in found])])
            pieces += [p[0] for p in found]
        for i in alone:
            found = self.split.pre_tokenize_str(self.normal.normalize_str(parts[i]))
            of.append(np.full(len(found), i))
            pieces += [p[0] for p in found]
        if pieces:
            codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
            borders = np.r_[0, np.cumsum([len(p) for p in pieces])]
            symbols = self.inner[codes]
            symbols[borders[1:] - 1] = self.final[codes[borders[1:] - 1]]
            total += np.bincount(owner[np.concatenate(of)], weights=self.merged(symbols, borders), minlength=len(words)).astype(np.int64)
        return total


def units(texts: pa.Array) -> W.Words:
    """What is tokenised and remembered: words at white space, without a mark at the end.

    The tokenizer splits there in any case, and it lower-cases all letters; of
    words with characters beyond Latin-1, where lower-casing and composing
    could depend on each other, and of possible special tokens the case counts.
    """
    return W.scan(texts, peel=True, unfolded=W.RARE)


class WordStore:
    """Numbers by word: ``number(words)`` gives for each distinct word's first place an entry, asking ``make`` for unknown ones."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make = make
        self.codes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def look_up(self, words: W.Words) -> np.ndarray:
        """The value of every word of the batch."""
        coded = pa.array(words.code).dictionary_encode()
        code, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.codes) > STORE_WORDS:
            self.codes, self.values = self.codes[:0], self.values[:0]
            self.emptied()
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        new = np.flatnonzero(self.codes[at] != code) if len(self.codes) else np.arange(len(code))
        if len(new):
            raw = words.buf.tobytes()
            first = np.empty(len(code), np.int64)
            first[back[::-1]] = np.arange(len(back))[::-1]
            places = first[new]
            texts = [raw[s:e].decode() for s, e in zip(words.start[places].tolist(), words.end[places].tolist(), strict=True)]
            values = self.make(texts)
            codes = np.concatenate([self.codes, code[new]])
            order = np.argsort(codes, kind="stable")
            self.codes, self.values = codes[order], np.concatenate([self.values, values])[order]
            at = np.searchsorted(self.codes, code)
        return self.values[at][back] if len(code) else np.zeros(0, np.int64)

    def emptied(self) -> None:
        pass


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, as the tokenizer library gives them without added tokens.

    Pre-tokens of the words not seen before are merged together as ragged
    arrays of symbols (see MergeCounter). Null and empty texts have 0 tokens;
    null and repeated doc_ids keep their rows; other columns are ignored;
    texts of any length are counted whole.
    """
    prepare(docs.sparkSession, LARGE_BATCH)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(MergeCounter(path).count)
        for b in batches:
            words = units(b["text"])
            sums = np.r_[0, np.cumsum(store.look_up(words))]
            tokens = np.diff(sums[words.first])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(words.offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class IdStore(WordStore):
    """Token ids by word: the value is the word's place in a ragged array of ids."""

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        super().__init__(self._encode)
        self.emptied()

    def emptied(self) -> None:
        """Entry 0 is the end of a document."""
        own = [] if self.end_id is None else [self.end_id]
        self.ids, self.lengths = [np.array(own, np.uint32)], [np.array([len(own)], np.int64)]
        self.known = 1

    def _encode(self, words: list[str]) -> np.ndarray:
        """Entries of new words. Words of Latin letters are one pre-token each, so many of them can be encoded as one text and told apart by the tokens that end a word."""
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
        other = sorted(set(range(len(words))) - set(plain))
        groups = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        joined = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False)
        order: list[int] = []
        for group, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(group):
                other += group
                continue
            order += group
            self.ids.append(ids)
            self.lengths.append(np.diff(np.r_[-1, ends]))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        self.lengths.append(np.array([len(x) for x in found], np.int64))
        self.ids.append(np.array([i for x in found for i in x], np.uint32))
        entries = np.empty(len(words), np.int64)
        entries[np.array(order + other, np.int64)] = np.arange(self.known, self.known + len(words))
        self.known += len(words)
        return entries

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the batch's documents, one after the other, each with its end, and their borders."""
        entry = np.insert(self.look_up(words), words.first[1:], 0)
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        length = self.lengths[0]
        begin = np.cumsum(length) - length
        size = length[entry]
        to = np.cumsum(size)
        ids = self.ids[0][np.repeat(begin[entry] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
        last = words.first[1:] + np.arange(len(words.first) - 1)
        return ids, np.r_[0, to[last]] if len(last) else np.zeros(1, np.int64)
