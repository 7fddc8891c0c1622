"""Token counts with the tokenizers library: Arrow batches in, lengths out.

Spark splits the input files by bytes, and inside a task texts are gathered to blocks of about BLOCK bytes,
long ones in parts that end at white space. The vocabulary's pre-tokenizer drops white space and none of
its patterns spans it, so ASCII white space is a safe boundary: a text has as many tokens as its words have.
Each block's new words are encoded as one batch; counts of words seen before are kept, up to MEMO of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import columns
from gridloom.llm.pieces import parts

BLOCK = 4 << 20
MEMO = 300_000
#: Pairs of words that a tokenizer is tried on, apart and with white space between them.
PROBES = (("word", "word"), ("don't", "'s"), ("12", "345"), ("e.g.", ",x"), ("日本", "語"), ("é", "́x"), ("--", "--"), ("<s>", "</s>"))


class WordCounter:
    """Tokens per text for one tokenizer file; each worker process holds one per task."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.check_boundaries()

    def check_boundaries(self) -> None:
        """Refuse a tokenizer to which white space isn't a boundary: its words can't be counted one by one."""
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        for left, right in PROBES:
            for space in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n\t", "\r\n"):
                if ids(f"{space}{left}{space}{right}{space}") != ids(left) + ids(right):
                    raise ValueError(f"this tokenizer has tokens that hold or span white space: {left!r}, {space!r}, {right!r}")

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > MEMO:
            self.known.clear()
        new = list(words - self.known.keys())
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in block], add_special_tokens=False)
            self.known.update(zip(block, map(len, found)))

    def count(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        block: list[tuple[int, list[bytes]]] = []
        held = 0

        def flush() -> None:
            self.learn(set().union(*(w for _, w in block)))
            for i, words in block:
                out[i] += sum(map(self.known.__getitem__, words))
            block.clear()

        for i, text in enumerate(texts):
            for part in parts(text):
                block.append((i, part.split()))
                held += len(part)
                if held >= BLOCK:
                    flush()
                    held = 0
        if block:
            flush()
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens.

    path: a tokenizers .json file whose pre-tokenizer drops white space, at the same place on every machine. Null text
    counts as empty: 0 bytes, 0 tokens. No special tokens are added; their strings inside a text count as the
    library's default has it. Repeated rows are counted each; empty table: no rows.
    """
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    )
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or WordCounter(path)
            texts = b.column(1).to_pylist()
            n = pa.array(counter.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
