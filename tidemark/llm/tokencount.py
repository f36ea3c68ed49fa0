"""Token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies, and summed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.postings import distinct_terms, postings, sum_by_document

MAX_TOKENS = 512
#: Code points whose class differs between Unicode versions lie in these blocks only (or are not assigned, beyond U+FFFF).
_UNSURE = re.compile("[԰-֏ࡰ-࢟ఀ-೿₀-₟꜀-ꟿꬰ-꭯\U00010000-\U0010ffff]")


@lru_cache(4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding; loaded once per worker process."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PreTokens:
    """Splits texts into the pre-tokens of a byte-level tokenizer file; special strings are pre-tokens of their own.

    A pre-token is encoded alone to the same pieces as within its text.
    """

    def __init__(self, path: str, pattern: str, specials: list[str]):
        self.path, self.pattern, self.specials = path, pattern, specials

    def __getstate__(self):
        return self.path, self.pattern, self.specials

    def __setstate__(self, state):
        self.path, self.pattern, self.specials = state

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.specials):
            return self._split(text)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text):
            out += [part] if part in self.specials else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if _UNSURE.search(text):  # the library's own splitting, slower
            return [text[a:b] for _, (a, b) in load(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return regex.findall(self.pattern, text)


def piece_counts(terms: DataFrame, path: str) -> DataFrame:
    """(term, n_tokens) of distinct pre-tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64())], ["term", "n_tokens"])
    return terms.select("term").mapInArrow(count, "term string, n_tokens long")


def count_tokens(docs: DataFrame, path: str, pattern: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 tokens). Repeated rows and rows without an id are counted one by one. Extra columns are
    ignored; an empty table gives an empty result. Whole texts are read; ids are never kept.
    """
    specials = [t.content for t in load(path).get_added_tokens_decoder().values()]
    split = PreTokens(path, pattern, specials)
    counts = piece_counts(distinct_terms(docs, split), path)
    sums = sum_by_document(postings(docs, split), counts, ["n_tokens"])
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
