"""Token counts that follow edits: a segment tree of pre-token blocks for each document."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.llm.bpe import VOCABULARY, Codec, read_ranks, worker_codec
from mdmill.llm.common import in_arrow, text_of
from mdmill.session import table

#: Pre-tokens of a leaf.
LEAF = 32
#: Characters behind a pre-token that decide where it ends, white space aside: the longest are the letters of 'll.
LOOK_AHEAD = 3


class TokenTree:
    """Token and character sums over leaves of LEAF pre-tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, codec: Codec, text: str):
        self.codec, self.text = codec, text
        tokens, chars = [], []
        for block in codec.pre_tokens(text):
            starts = np.arange(0, len(block), LEAF)
            tokens += np.add.reduceat(codec.count(block), starts).tolist()
            chars += np.add.reduceat(np.fromiter(map(len, block), np.int64, len(block)), starts).tolist()
        self.width = 1 << max(0, len(tokens) - 1).bit_length()
        pad = [0] * (self.width - len(tokens))
        self.tokens, self.chars = [0] * self.width + tokens + pad, [0] * self.width + chars + pad
        for node in range(self.width - 1, 0, -1):
            self._sum(node)
        self.encoded = len(text)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop]; only touched leaves and the context at their borders are encoded again.

        Encoding starts at the leaf that holds the character LOOK_AHEAD before
        the edit, or earlier where only white space lies between the leaf's
        start and the edit: a run of white space is split by what follows it.
        Pre-tokens before that see nothing of the edit. It stops where, behind
        the edit, a pre-token ends at an old leaf's border: from there on the
        text and so its pre-tokens are the old ones.
        """
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        grown = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        first, at = self._find(max(start - LOOK_AHEAD, 0)) if self.chars[1] else (self.width, 0)
        while at and self.text[at:start].isspace():
            first, at = self._find(at - 1)
        leaf, border = first, at + self.chars[first]
        words, end, from_char = [], at, at
        for match in self.codec.find(self.text, at):
            words.append(match.group())
            end = match.end()
            while leaf < 2 * self.width - 1 and border + grown < end:
                leaf += 1
                border += self.chars[leaf]
            if end >= start + len(new) and border >= stop and border + grown == end:
                break
        else:
            leaf = 2 * self.width - 1
        self.encoded += end - from_char
        touched = range(first, leaf + 1)
        for node in touched:
            self.tokens[node], self.chars[node] = 0, 0
        self.tokens[first], self.chars[first] = int(self.codec.count(words).sum()), end - from_char
        level = {node // 2 for node in touched} - {0}
        while level:
            for node in level:
                self._sum(node)
            level = {node // 2 for node in level} - {0}


def count_with_edits(docs: DataFrame, edits: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_again), a row for each row of docs.

    edits is an array of (start, stop, text) structs; each replaces code points
    [start, stop) of what the ones before it have left, and bounds beyond the
    text are drawn in. encoded_again counts the characters that the edits had
    encoded again. Null texts count as empty, null edits as none. Repeated
    rows and null ids pass through; other columns are ignored. A task holds one
    text and its tree.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches):
        codec = worker_codec(vocabulary.value, pattern)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = TokenTree(codec, text.as_py())
                before, plain = tree.count, tree.encoded
                for change in changes.as_py() or ():
                    tree.edit(change["start"], change["stop"], change["text"])
                rows.append((plain, before, len(tree.text), tree.count, tree.encoded - plain))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_again"],
            )

    rows = docs.select("doc_id", text_of().alias("text"), edits.alias("edits"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        rows, run, f"doc_id {kind}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_again long"
    )


def sample_edits() -> Column:
    """Three edits of any text: a deletion, an insertion and a replacement that depend on its length and id."""
    n = F.length(text_of())
    third = F.floor(n / 3).cast("int")
    made = lambda start, stop, text: F.struct(start.alias("start"), stop.alias("stop"), text.alias("text"))
    return F.array(
        made(third, third + 20, F.lit("")),
        made(F.lit(0), F.lit(0), F.lit("Edited. ")),
        made(2 * third, 2 * third + 5, F.concat(F.lit(" no. "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))),
    )


def op8_token_counts(spark, sf_dir):
    return count_with_edits(table(spark, sf_dir, "documents"), sample_edits())
