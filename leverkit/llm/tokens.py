"""Operator 3: token counts by trie-shared dynamic programming.

A unigram tokenizer cuts a pre-token (a word with the word mark in front) into
the pieces with the largest sum of scores.  The distinct pre-tokens of a run of
rows are put in order, which is the depth-first order of their trie: going from
one to the next keeps the forward scores of the prefix they share and computes
only the nodes below it.  The number of tokens of the best cut is stored at the
pre-token's terminal node, and every occurrence looks it up.

Nothing is shuffled: a run of rows (a bounded number of bytes) has its own trie,
of which only the path to the current node is held.

No unigram scores are among the public files, so pieces are scored by Zipf's
law over the ranks of a public vocabulary; other scores can be passed in.  A
character that no piece covers costs its UTF-8 bytes, one token each.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import SPACE_WORDS, importable, row_chunks, scan_words, table, text_buffers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: bytes of text that share a trie
RUN_BYTES = 24 << 20
#: a byte token scores this much less than the least piece
BYTE_PENALTY = 10.0


def zipf_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Natural-log scores of the pieces of a sentencepiece vocabulary file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {x: -math.log(r + 2.7) - total for r, x in enumerate(pieces)}


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY

    def _extend(self, word: str, best: list[float], count: list[int]):
        """Forward scores of the nodes of ``word`` that ``best`` does not have yet."""
        get = self.scores.get
        for end in range(len(best), len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, cost = best[end - 1] + n * self.byte, count[end - 1] + n
            for start in range(max(0, end - self.longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or s == top and count[start] + 1 < cost:
                        top, cost = s, count[start] + 1
            best.append(top)
            count.append(cost)

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = [0] * len(words)
        best, count, last = [0.0], [0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            shared, top = 0, min(len(last), len(word))
            while shared < top and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            self._extend(word, best, count)
            out[i], last = count[-1], word
        return out


def _count(model_b):
    def run(batches):
        for b in batches:
            offs, _ = text_buffers(b.column("text"))
            for lo, hi in row_chunks(offs, RUN_BYTES):
                part = b.slice(lo, hi - lo)
                seen = pd.Index(np.zeros(0, np.uint64))
                names, hashes, n_words = [], [], []
                for c in scan_words(part.column("text"), SPACE_WORDS, lower=False):
                    u, at = np.unique(c.hash, return_index=True)
                    new = ~np.isin(u, seen.to_numpy()) if len(seen) else np.ones(len(u), bool)
                    names += [MARK + c.text(j, j + 1) for j in at[new].tolist()]
                    seen = seen.append(pd.Index(u[new]))
                    hashes.append(c.hash)
                    n_words.append(np.diff(c.first))
                n = np.array(model_b.value.counts(names) + [0], np.int64)
                n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
                tokens = [n[seen.get_indexer(h)] for h in hashes]
                total = np.concatenate([[0], np.cumsum(np.concatenate(tokens))]) if tokens else np.zeros(1, np.int64)
                ends = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in part.schema.names if x != "text"), pa.array(n_words, pa.int64()),
                     pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())],
                    [*(x for x in part.schema.names if x != "text"), "n_words", "n_tokens"])
    return run


def token_counts(docs: DataFrame, scores: dict[str, float] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document: doc_id, n_words (pre-tokens) and n_tokens.

    ``scores`` (piece to log score) or the vocabulary file is read on the
    driver and broadcast; its size is the vocabulary's, whatever the corpus.

    Defined cases: null and empty texts have no tokens; rows are independent,
    so repeated rows agree; a very long word is cut whole; an empty table gives
    no rows; other columns are not looked at.
    """
    importable(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Unigram(zipf_scores(vocabulary) if scores is None else scores))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _count(model), "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
