"""Token counts by the whole-token shortcut.

A piece model of the BPE kind merges inside pre-tokens only, as long as no
vocabulary string spans the place where two pre-tokens meet. That is proved
from the vocabulary when the model is loaded: no string has a space mark after
another character, and none has a line feed. A text then falls into pre-tokens
at spaces and line feeds whose counts add up. The vocabulary strings that
encode alone as one token are found at the same time; pre-tokens equal to one
of them count one without any merging, and only the rest is merged, each
distinct string once per worker while the bounded memory of counts holds it.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import settled

MARK = "▁"
#: Strings remembered per worker, and the longest string that is remembered.
MEMORY, LONGEST = 1_000_000, 64

_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class _Counts(dict):
    """Tokens of a pre-token, by its text without its one leading space."""

    def __init__(self, merged, lead: str, known: set[str]):
        super().__init__()
        self.merged, self.lead, self.known = merged, lead, known
        self.update((k[len(lead):], 1) for k in known if k.startswith(lead))

    def __missing__(self, text: str) -> int:
        n = self.merged(self.lead + text)
        if len(text) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
                self.update((k[len(self.lead):], 1) for k in self.known if k.startswith(self.lead))
            self[text] = n
        return n


class TokenCounter:
    """Counts the tokens of whole texts for one piece model."""

    def __init__(self, model: bytes):
        import sentencepiece as sp

        self.model = sp.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        plain = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        # Proof that pre-tokens are independent; without it whole texts are merged.
        spans = any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        kept = self.model.encode("a  b", out_type=str) == self.model.encode("a▁▁b", out_type=str) and len(self.model.encode("\n")) == 2
        self.splits = not spans and kept
        self.alone: set[str] = set()
        if self.splits:
            surface = [p.replace(MARK, " ") for p in plain]
            self.alone = {s for s, n in zip(surface, self._merge_all(surface), strict=True) if n == 1}
        self.first = _Counts(self._merge, "", self.alone)
        self.spaced = _Counts(self._merge, " ", self.alone)

    def _merge_all(self, pieces: list[str]) -> list[int]:
        # The line feed keeps the model from adding its own leading mark to the piece.
        return [len(x) - 2 for x in self.model.encode(["\n" + p for p in pieces], num_threads=1)]

    def _merge(self, piece: str) -> int:
        return len(self.model.encode("\n" + piece)) - 2

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        lines = (" " + text).split("\n")
        total, first, spaced = len(lines) - 1, self.first, self.spaced
        for line in lines:
            if not line:
                continue
            if "  " in line:
                for run in _RUNS.findall(line):
                    total += spaced[run[1:]] if run[0] == " " else first[run]
                continue
            parts = line.split(" ")
            if parts[0]:
                total += first[parts[0]]
            del parts[0]
            total += sum(map(spaced.__getitem__, parts))
        return total


@functools.lru_cache(maxsize=2)
def counter(model: bytes) -> TokenCounter:
    return TokenCounter(model)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs with n_bytes, n_tokens and over_limit.

    One narrow pass without a shuffle. A null or empty text has 0 bytes and 0
    tokens; repeated rows are counted one by one; no text is cut; columns
    other than keep are not read.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(*keep, docs[text].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def counts(batches):
        tokens = counter(model)
        for batch in batches:
            texts = batch.column(len(keep))
            n = pa.array((tokens.count(x.as_py()) for x in texts), pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), size, n, pa.compute.greater(n, limit)],
                [*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(settled(counts), f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
