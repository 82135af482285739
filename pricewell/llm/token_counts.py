"""Token counts: batches of about equal bytes are encoded, and only the lengths come back.

A text is cut at ASCII white space, where no word, special string or character combination goes
on: for a vocabulary that drops white space the pieces have together as many tokens as the text.
A batch encodes each distinct piece that the task has not met before; however long a text
is, the library sees pieces of it only. A long piece without white space is cut where the vocabulary's
words end whatever comes next: around ASCII digits, between ASCII letters and punctuation, between
ideographs or kana and their punctuation. What remains whole is one word, a run of letters or of signs, which BPE
has to see as one. The vocabulary is checked: one that keeps white space or cuts words otherwise is refused.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.tables import kept_in_worker, text_ranges, whole_text, with_fields

#: So many pieces are remembered in a worker before all are forgotten.
REMEMBERED = 500_000
#: Texts are cut into pieces so many bytes at a time.
TEXT_BYTES = 4_000_000
#: Pieces of more bytes are cut further, into parts of so many characters or, up to the next safe place, more. They aren't remembered.
LONG_PIECE, PART = 4_096, 1_024
#: Fixed value: what the vocabulary takes as a word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Safe places. No sign of a special string is next to one, and no apostrophe, which may begin a word with the letters behind it.
_SIGN, _SCRIPT, _STOPS = r"!-&(-/:;=?@\[-`{}~", "\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa", "\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b"
SAFE = re.compile(
    rf"(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=['{_SIGN}])|(?<=[{_SIGN}])(?=[A-Za-z])"
    f"|(?<=[{_SCRIPT}])(?=[{_STOPS}])|(?<=[{_STOPS}])(?=[{_SCRIPT}])"
)


def library_tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, without truncation and padding, in one thread.

    A vocabulary in which a word may go on behind a place where texts are cut is a ``ValueError``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not _cuts_safely(spec):
        raise ValueError("not a vocabulary of words without white space")

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _cuts_safely(spec: dict) -> bool:
    """Whether a vocabulary's words, special strings and rewritten characters all end at white space and safe places."""
    normalizer, pre = spec["normalizer"] or {"type": "Sequence", "normalizers": []}, spec["pre_tokenizer"] or {}
    rewrites = normalizer.get("normalizers", [normalizer])
    spaces = [(r["pattern"], r["content"]) for r in rewrites if r["type"] == "Replace"]
    cuts = pre.get("pretokenizers", [pre])
    return (
        all(r["type"] in ("NFC", "Lowercase", "Replace") for r in rewrites)
        and all(found == ({"Regex": r"\s+"}, " ") for found in spaces)
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
        and not cuts[1]["use_regex"]
        and not cuts[1]["add_prefix_space"]
        and all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    )


def parts(piece: bytes, least: int) -> Iterator[bytes]:
    """A piece cut at safe places into parts of at least so many characters (the last may have fewer)."""
    text = piece.decode()
    start = 0
    while found := SAFE.search(text, start + least):
        yield text[start : found.start()].encode()
        start = found.start()
    yield text[start:].encode()


def balanced(pieces: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Batches of about ``most`` bytes; a longer piece is a batch of its own."""
    batch: list[bytes] = []
    held = 0
    for piece in pieces:
        if batch and held + len(piece) > most:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += len(piece)
    if batch:
        yield batch


def lengths(texts: list[bytes], tokenizer, known: dict[bytes, int], batch_bytes: int) -> list[int]:
    """The token count of each UTF-8 text; ``known`` has the counts of pieces met before and gets new ones."""
    encoded = lambda batch: tokenizer.encode_batch_fast([x.decode() for x in batch], add_special_tokens=False)
    if len(known) > REMEMBERED:
        known.clear()
    cut = [text.split() for text in texts]
    fresh = set().union(*cut).difference(known)
    long = [piece for piece in fresh if len(piece) > LONG_PIECE]
    for batch in balanced(fresh.difference(long), batch_bytes):
        known.update(zip(batch, map(len, encoded(batch)), strict=True))
    for piece in long:
        known[piece] = sum(len(x) for batch in balanced(parts(piece, PART), batch_bytes) for x in encoded(batch))
    count = known.__getitem__
    counts = [sum(map(count, pieces)) for pieces in cut]
    for piece in long:
        del known[piece]
    return counts


def counted(docs: DataFrame, path: str, text_col: str = "text", batch_bytes: int = 200_000) -> DataFrame:
    """The rows without their text, with ``n_bytes`` (UTF-8) and ``n_tokens``.

    Counts are the library's for the vocabulary file, without added special tokens; special strings
    inside texts are handled as it does by default. Whole texts are counted; null counts as empty
    and has 0 tokens. Columns of the input named as the counts are replaced, all others stay.
    """
    added = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)]
    others = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    schema = with_fields(others, *added)
    carried = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = kept_in_worker(("token_counts", path), lambda: (library_tokenizer(path), {}))
        for whole in batches:
            for start, end in text_ranges(whole.column("__text"), TEXT_BYTES):
                batch = whole.slice(start, end - start)
                texts = batch.column("__text").cast(pa.binary()).to_pylist()
                counts = pa.array(lengths(texts, model, known, batch_bytes), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), batch.column("n_bytes"), counts], names=schema.names)

    text = whole_text(text_col)
    return docs.select(*carried, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text")).mapInArrow(run, schema)
