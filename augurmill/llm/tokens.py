"""Token counts and token ids of whole texts, exactly as the tokenizers library gives them, but faster.

**Encoding.** The library is slow on words that are not in its vocabulary. The
same vocabulary's ranks file gives the same ids several times faster where a text has
no special strings and only characters whose classes have never changed; other texts
go to the library. Where all white space is single and between visible characters,
the pattern's look-ahead can never match, so a pattern without it cuts the same words
faster still. The tests hold all three equal.

**Overlap resynchronisation** (`count_long`). A huge text is encoded in overlapping
chunks, each with offsets. A boundary between two pre-tokens that both chunks have,
in the part they share and clear of the first chunk's end by the length of the
longest special string, is a boundary of the whole text: the first chunk's scan is
right up to there, and what follows depends on nothing before it. Counts are spliced
at such a boundary. Where there is none the overlap doubles, at last up to the whole
text, so a result is never approximate and memory stays with the chunk.
"""

from __future__ import annotations

import base64
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, table

#: The vocabulary's word pattern without its look-ahead.
SINGLE_SPACES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Outside of what every Unicode version of the last twenty years classes alike.
_UNUSUAL = re.compile("[^\t\n\r -~\xa0-\u0220\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts -> ids, as the library gives them."""

    _made: dict[tuple, Encoder] = {}

    @classmethod
    def get(cls, path: str, ranks: str | None) -> Encoder:
        """One per worker process and vocabulary."""
        if (path, ranks) not in cls._made:
            cls._made[path, ranks] = cls(path, ranks)
        return cls._made[path, ranks]

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.simple, self.full = Tokenizer.from_file(path), None, None
        with open(path) as f:
            self.longest_special = max([len(x["content"]) for x in json.load(f)["added_tokens"]], default=0)
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.simple, self.full = (tiktoken.Encoding(x, pat_str=x, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
                                      for x in (SINGLE_SPACES, public_tokenizers.PATTERN))

    def ids(self, text: str) -> list[int]:
        if self.simple is None or "<|" in text or _UNUSUAL.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if text.split() == text.replace("\n", " ").split(" "):
            return self.simple(text)
        return self.full(text)


def boundaries(encoding, chunk: str) -> dict[int, int]:
    """End of a pre-token that closes with a visible character -> tokens up to it."""
    ends, words = encoding.offsets, encoding.word_ids
    return {ends[k][1]: k + 1 for k in range(len(ends) - 1)
            if words[k] != words[k + 1] and ends[k][1] and not chunk[ends[k][1] - 1].isspace()}


def count_long(text: str, encoder: Encoder, chunk: int, overlap: int) -> int:
    encode = lambda part: encoder.library.encode(part, add_special_tokens=False)
    at, upto = 0, min(chunk, len(text))
    left, before, total = encode(text[at:upto]), 0, 0
    while upto < len(text):
        own, width, spliced = boundaries(left, text[at:upto]), overlap, False
        clear = upto - encoder.longest_special - 1
        while not spliced:
            start = max(at, upto - width)
            end = min(start + max(chunk, 2 * width), len(text))
            right = encode(text[start:end])
            other = boundaries(right, text[start:end])
            common = [p for p in own if start < p + at <= clear and own[p] > before and (p + at - start) in other]
            if common:
                p = max(common)
                total += own[p] - before
                at, upto, left, before, spliced = start, end, right, other[p + at - start], True
            elif start == at:  # nothing to splice at: the chunks become one
                end = min(end + chunk, len(text))
                at, upto, left, spliced = at, end, encode(text[at:end]), True
            else:
                width *= 2
    return total + len(left.ids) - before


def token_counts(docs: DataFrame, tokenizer: str, ranks: str | None = None, chunk: int = 65_536, overlap: int = 1_024, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text.

    One row per row of `docs` (doc_id, text; other columns are not read), repeated
    rows included: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). A null
    text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null. An empty table
    gives an empty table. Texts over `chunk` characters go by overlapping chunks.
    """
    counted = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = counted.schema["doc_id"].dataType.simpleString()

    def step(batches):
        encoder = Encoder.get(tokenizer, ranks)
        for b in batches:
            own = [x or "" for x in b.column("text").to_pylist()]
            tokens = [len(encoder.ids(x)) if len(x) <= chunk else count_long(x, encoder, chunk, overlap) for x in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = arrow_map(counted, step, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@llm_query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf, "documents"), tokenizer_path(), ranks_path())
