"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces that end at each character; the best
score and the piece count of the best path are carried from character to character, and
no path is kept. The rules are those of the public unigram tokenizers: a path is
replaced only by a strictly better one and longer pieces come first, so on a tie the
longer last piece wins; a character that is no piece itself costs the smallest score less
10; neighbouring unknown characters are one unknown token, or with byte fallback one
token a byte.

If no piece holds the space mark after another character, and scores are whole numbers
(sums are then exact in any order), the best path of a text is made of the best paths of
its words, which are remembered; otherwise texts are taken in one go."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import tune, with_columns

MARK = "▁"
UNKNOWN_COST = 10.0
MEMO = 400_000
_memos: dict[str, dict] = {}  # words that this worker has counted, by the counter's digest


class UnigramCounter:
    """pieces: (piece, score) in order of id; the first of equal pieces counts. bytes_: each
    unknown byte is a token (the vocabulary has all byte pieces)."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_: bool):
        self.pieces, self.bytes_ = pieces, bytes_
        whole = all(float(s).is_integer() for _, s in pieces)
        inside = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = whole and any(p == MARK for p, _ in pieces) and not any(inside.search(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        self._automaton = None
        rules = hashlib.blake2b(repr((bytes_, self.unknown, [(p, float(s)) for p, s in pieces])).encode("utf-8", "surrogatepass"))
        self.digest = rules.hexdigest()

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _best(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best path over `text`."""
        if self._automaton is None:
            self._automaton = a = ahocorasick.Automaton()
            for p, s in self.pieces:
                if p and p not in a:
                    a.add_word(p, (len(p), float(s)))
            a.make_automaton()
        n = len(text)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached, done = [True] + [False] * n, 0

        def unknown(i: int) -> None:
            """The single character before i as an unknown, the last candidate of its end."""
            score = best[i - 1] + self.unknown
            if not reached[i] or score > best[i]:
                reached[i], best[i], unk[i] = True, score, True
                count[i] = count[i - 1] + (len(text[i - 1].encode("utf-8", "surrogatepass")) if self.bytes_ else not unk[i - 1])

        single = False
        for last, (length, s) in self._automaton.iter(text):
            end = last + 1
            while done < end - 1:  # ends without a piece, and the one just left
                done += 1
                if not single:
                    unknown(done)
                single = False
            start = end - length
            score = best[start] + s
            if not reached[end] or score > best[end]:
                reached[end], best[end], count[end], unk[end] = True, score, count[start] + 1, False
            single = single or length == 1
        while done < n:
            done += 1
            if not single:
                unknown(done)
            single = False
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a text; null and empty: (0, 0)."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        if not self.by_word:
            return self._best(text)
        memo = _memos.get(self.digest)
        if memo is None:
            _memos.clear()  # one vocabulary's words at a time
            memo = _memos[self.digest] = {}
        tokens, score = 0, 0.0
        # a word: space marks, then all up to the next mark
        for word in re.findall(f"{MARK}+[^{MARK}]*", text):
            got = memo.get(word)
            if got is None:
                got = self._best(word)
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


def load(model: str) -> UnigramCounter:
    """The counter over a sentencepiece file's pieces and scores; the file is read on the
    driver only. Control and unknown pieces are no text and are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return UnigramCounter([(sp.id_to_piece(i), sp.get_score(i)) for i in ids], sum(sp.is_byte(i) for i in range(sp.get_piece_size())) == 256)


def token_counts(docs: DataFrame, counter: UnigramCounter, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens and token_score of each whole text; null and empty texts have no
    tokens and score 0. A row's result depends on its text alone, so repeated rows and rows
    without an id are counted like any. Columns of `docs` named n_tokens or token_score are
    replaced; all others pass through. A word of any length, and a text without word
    marks, is taken in one go (some 100 bytes a character). An empty table gives no rows."""

    def make():
        def run(texts):
            got = [counter.count(t) for t in texts]
            return [g[0] for g in got], [g[1] for g in got]

        return run

    return with_columns(docs, [text_col], {"n_tokens": "long", "token_score": "double"}, make)


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, load(model)).drop("text")
