"""Word-piece counts by a linear longest-match automaton."""

from collections import deque
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from jobstrata.llm import arrays

#: Words, and every other visible character by itself.
SPLIT = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]")
#: Different words whose counts a worker keeps; a full store starts anew.
CACHED = 300_000


class Automaton:
    """Trie of word-initial and of inner pieces, with failure links.

    The failure link of a node is where matching goes on once the pieces that are certain at the node are
    popped; how many these are is stored with the link. So a word is read once, in linear time, and greedy
    longest-match-first lengths come out without building any piece.
    """

    ROOT, INNER = 0, 1

    def __init__(self, initial, inner):
        self.next, self.fail, self.pops = [{}, {}], [None, None], [0, 0]
        ends = set()
        for root, vocabulary in ((self.ROOT, initial), (self.INNER, inner)):
            for piece in vocabulary:
                node = root
                for char in piece:
                    if char not in self.next[node]:
                        self.next[node][char] = len(self.next)
                        self.next.append({})
                        self.fail.append(None)
                        self.pops.append(0)
                    node = self.next[node][char]
                if piece:
                    ends.add(node)
        queue = deque([self.ROOT, self.INNER])
        while queue:
            above = queue.popleft()
            for char, node in self.next[above].items():
                if node in ends:
                    self.fail[node], self.pops[node] = self.INNER, 1
                else:
                    back, popped = self.fail[above], self.pops[above]
                    while back is not None and char not in self.next[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back is not None:
                        self.fail[node], self.pops[node] = self.next[back][char], popped
                queue.append(node)

    def count(self, word):
        """Number of pieces of the word; 0 if it cannot be cut into pieces."""
        node, pieces = self.ROOT, 0
        for char in word:
            while char not in self.next[node]:
                pieces += self.pops[node]
                node = self.fail[node]
                if node is None:
                    return 0
            node = self.next[node][char]
        while node != self.INNER:
            pieces += self.pops[node]
            node = self.fail[node]
            if node is None:
                return 0
        return pieces


def vocabulary(path):
    """Word-initial and inner pieces of a sentencepiece model file: those with and without its word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    inner = [p for p in pieces if not p.startswith("▁")]
    return [p[1:] for p in pieces if p.startswith("▁")] + [p for p in inner if len(p) == 1], inner


class _Counts(dict):
    def __init__(self, path):
        self.automaton = Automaton(*vocabulary(path))

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        count = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = count
        return count


@lru_cache(maxsize=2)
def _counts(path):
    return _Counts(path)


def count_tokens(docs, path):
    """Every row's doc_id, n_words, n_tokens and n_unknown over its whole text.

    Words are runs of letters, marks, digits and underscores; any other visible character is a word. Each
    takes the longest piece again and again, word-initial pieces first; a word that cannot be cut so is one
    unknown token. Null and empty texts have none. Null ids, repeated rows and empty tables pass as they
    are; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_tokens", "n_unknown"))])

    def run(batches):
        counts = _counts(path)
        for batch in arrays.pieces(batches, "text"):
            words = [SPLIT.findall(text or "") for text in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            each = np.fromiter(map(counts.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            tokens = np.concatenate([[0], np.cumsum(np.maximum(each, 1))])
            unknown = np.concatenate([[0], np.cumsum(each == 0)])
            yield arrays.record_batch(schema, batch.column("doc_id"), sizes, tokens[ends] - tokens[ends - sizes],
                                      unknown[ends] - unknown[ends - sizes])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long"))
