"""Byte-level BPE encoding and decoding with shared prefixes.

The distinct words of a batch, sorted, are a trie in depth-first order: what a word shares with
the word before it is the path above the branch. For every node the traversal keeps the last token
of the encoding of the path down to it. The encoding of a path is that of a shorter path plus one
token, so the last token of a node is the one vocabulary entry that ends the path, and whose pair
with the last token before it stays as it is under the merges. A word's tokens are read off by
going back from its node; a shared prefix is encoded once. The time is linear in the word's length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.tables import kept_in_worker, sent_to_python, text_ranges, with_fields

#: The words of this kind of vocabulary, and the printable characters for its bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words for texts of characters up to 0x24F only, for the faster of the two regex libraries.
LETTERS, NUMBERS, SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
PLAIN_WORDS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
ODD = re.compile("[^\x00-\u024f]")
#: Encodings of all prefixes of a word are kept up to this length in bytes.
LONG = 64
SHORT = (2, 1)
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary file with the traversal above."""

    #: So many words are remembered between batches before all are forgotten, and so many pairs of tokens.
    remembered = 200_000
    remembered_pairs = 200_000

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        chars = byte_of_char()
        raw = lambda s: bytes(chars[c] for c in s)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        #: By the last three bytes of a path: the lengths of the tokens that may end it.
        self.ending = {end: (*sorted(found, reverse=True), *SHORT) for end, found in lengths.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (merge.split(" ") if isinstance(merge, str) else merge)
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            self.rank[a, b] = rank
            self.halves.setdefault(self.ids[raw(left) + raw(right)], (a, b))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = [i.to_bytes(4, "little") for i in range(size)]
        self.words, self.plain_words = regex.compile(WORDS), re.compile(PLAIN_WORDS)
        self.known: dict[str, bytes] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that one after the other are a token's outer part on a side, while it is merged.

        With each goes the rank of the merge that takes it in; the whole token is never taken in.
        """
        found = self.edges[side].get(token)
        if found is None:
            found, taken = [], float("inf")
            part = token
            while True:
                found.append((part, taken))
                if part not in self.halves:
                    break
                taken = self.rank[self.halves[part]]
                part = self.halves[part][side]
            self.edges[side][token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens in a row are what the merges make of their bytes.

        They are unless some merge across the border comes before the merges that take in its parts. Of
        equal merges the one further left comes first.
        """
        return not any(
            (rank := self.rank.get((a, b))) is not None and rank < end_a and rank <= end_b
            for a, end_a in self._edge(left, 1)
            for b, end_b in self._edge(right, 0)
        )

    def learn(self, words: set[str]) -> None:
        """Encodes distinct words by one traversal of their trie and remembers the results."""
        token_of, fits, pairs, ending, size = self.ids.get, self.fits, self.pairs, self.ending.get, self.size
        if len(pairs) > self.remembered_pairs:
            pairs.clear()
        path = b""
        last: list[int] = []  # by the length of the path less one: its last token
        whole: list[bytes] = []  # and its encoding
        for word in sorted(words):  # code points sort as their UTF-8 bytes do
            raw = word.encode()
            shared = 0
            for x, y in zip(path, raw):
                if x != y:
                    break
                shared += 1
            del last[shared:], whole[shared:]
            for end in range(shared + 1, len(raw) + 1):
                for length in ending(raw[end - 3 : end], SHORT) if end > 2 else SHORT:
                    begin = end - length
                    token = token_of(raw[begin:end]) if begin >= 0 else None
                    if token is None:
                        continue
                    if not begin:
                        whole.append(size[token])
                        break
                    pair = last[begin - 1] << 32 | token
                    fit = pairs.get(pair)
                    if fit is None:
                        fit = pairs[pair] = fits(last[begin - 1], token)
                    if fit:
                        whole.append(b"" if end > LONG else whole[begin - 1] + size[token])
                        break
                last.append(token)
            path = raw
            if len(raw) <= LONG:
                self.known[word] = whole[-1]
            else:  # read off from the end, as every step's encoding would take too much room
                tokens, at = [], len(raw)
                while at:
                    tokens.append(size[last[at - 1]])
                    at -= len(self.bytes[last[at - 1]])
                self.known[word] = b"".join(reversed(tokens))

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        return (self.words if ODD.search(text) else self.plain_words).findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers. Special strings are their special tokens."""
        pieces: list[list[list[str] | int]] = []
        for text in texts:
            parts: list[list[str] | int] = []
            at = 0
            for hit in self.cut.finditer(text) if self.cut else ():
                parts += [self.split(text[at : hit.start()]), self.special[hit.group()]]
                at = hit.end()
            parts.append(self.split(text[at:] if at else text))
            pieces.append(parts)
        if len(self.known) > self.remembered:
            self.known.clear()
        words = set().union(*(p for parts in pieces for p in parts if not isinstance(p, int)))
        self.learn(words.difference(self.known))
        known, size = self.known.__getitem__, self.size
        return [b"".join(size[p] if isinstance(p, int) else b"".join(map(known, p)) for p in parts) for parts in pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encoded(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    batch_bytes: int = 1_000_000,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    finished: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``token_ids`` and ``decoded``, the text that the ids give back.

    Whole texts are encoded; null counts as empty and has no ids. Columns of the input with these
    names are replaced, all others stay. ``path`` names a vocabulary file that every worker can read.
    ``keep`` names the columns of the input that come back, otherwise all do. ``finish`` is applied to the batches of the result in the same worker and gives rows of the schema
    ``finished``, so that ids which are only summed up need not leave it.
    """
    ids_type = T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)
    kept = docs.schema if keep is None else T.StructType([docs.schema[c] for c in keep])
    schema = with_fields(kept, ids_type, T.StructField("decoded", T.StringType(), False))
    carried = [f.name for f in schema.fields[:-2]]
    sent, text = sent_to_python(docs, carried, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_in_worker(("bpe", path), lambda: Tokenizer(path))
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for start, end in text_ranges(texts, batch_bytes):
                ids = model.encode_batch(texts.slice(start, end - start).to_pylist())
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                rows = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))
                back = pa.array([model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())
                kept = batch.slice(start, end - start)
                result = pa.RecordBatch.from_arrays([*(kept.column(c) for c in carried), rows, back], names=schema.names)
                yield finish(result) if finish else result

    return sent.mapInArrow(run, finished or schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(batch: pa.RecordBatch) -> pa.RecordBatch:
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    lists = batch.column("token_ids")
    bounds, flat = lists.offsets.to_pylist(), lists.values.to_numpy().astype("<u4")
    ids = [flat[start:end].tobytes() for start, end in zip(bounds, bounds[1:])]
    texts = batch.column("decoded").cast(pa.binary()).to_pylist()
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array(map(sha, ids), pa.string()),
            pa.array(map(sha, texts), pa.string()),
        ],
        names=[x.split()[0] for x in DIGESTS.split(", ")],
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_tokens and the digests of the ids and of the decoded text.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256`` over UTF-8.
    """
    return encoded(docs, path, finish=_digested, finished=DIGESTS, keep=["doc_id"])
