"""Lexicon tagging with a phrase automaton, row by row (M2, W3, J5 without a shuffle).

The phrases form a trie over word numbers with failure links (Aho and Corasick, CACM
1975), kept in compact arrays: the transitions as one sorted array, and per state the
failure link, the depth, the nearest shorter phrase that ends there and the label.  A
document's words are read once; every phrase that ends at a word is found on the way,
however phrases nest or overlap.  No window, join or grouping is needed, so the same
column expressions run in batch and on a stream.

Phrases too many for one worker stay a table (:func:`fitted`): the documents are dealt into
parts of bounded text, and each part gets the automaton of the phrases whose first words it
holds (:func:`dealt_spans`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.functions.text import BLANK, is_blank, text_slice, trim_ws
from spanlab.operators import tokens as tok
from spanlab.operators.lexicon import link_exact
from spanlab.session import written

#: The phrases' words of one automaton, in UTF-8 bytes.  An automaton takes some twenty times that, in the
#: driver and in every Python worker.
MAX_BYTES = 8 << 20
#: Text bytes of a part of the documents with an automaton of its own.
PART_BYTES = 4 << 20
#: First words of a phrase that a part must hold.
HEAD_WORDS = 3


class TooLarge(ValueError):
    """The phrases do not fit into the memory of one worker: deal them (:func:`fitted`)."""


@dataclass
class PhraseAutomaton:
    """Words are numbered from 1 in ``words``; state 0 is the root."""

    words: dict[str, int]
    keys: np.ndarray  # state * (number of words + 1) + word, sorted
    targets: np.ndarray  # the state that a key leads to
    fail: np.ndarray
    depth: np.ndarray
    label: np.ndarray  # of the phrase that ends in the state, or -1
    shorter: np.ndarray  # the next state on the failure path that ends a phrase, or 0
    labels: list[str]

    @classmethod
    def of(cls, phrases: list[tuple[list[str], str]]) -> PhraseAutomaton:
        """Of (words, label); of equal phrases the smallest label counts."""
        names = sorted({name for _, name in phrases})
        number = {name: n for n, name in enumerate(names)}
        words: dict[str, int] = {}
        children: list[dict[int, int]] = [{}]
        label, depth = [-1], [0]
        for phrase, name in phrases:
            state = 0
            for word in phrase:
                word = words.setdefault(word, len(words) + 1)
                if word not in children[state]:
                    children[state][word] = len(children)
                    children.append({})
                    label.append(-1), depth.append(depth[state] + 1)
                state = children[state][word]
            if phrase and (label[state] < 0 or number[name] < label[state]):
                label[state] = number[name]
        fail, shorter = [0] * len(children), [0] * len(children)
        level = list(children[0].values())
        while level:  # breadth first: a failure link leads to a lower level
            below = []
            for state in level:
                link = fail[state]
                shorter[state] = link if label[link] >= 0 else shorter[link]
                for word, child in children[state].items():
                    back = link
                    while back and word not in children[back]:
                        back = fail[back]
                    fail[child] = children[back].get(word, 0) if state else 0
                    below.append(child)
            level = below
        width = len(words) + 1
        pairs = sorted((state * width + word, child) for state, of in enumerate(children) for word, child in of.items())
        keys, targets = np.array(pairs, np.int64).reshape(-1, 2).T
        return cls(words, np.ascontiguousarray(keys), np.ascontiguousarray(targets.astype(np.int32)),
                   np.array(fail, np.int32), np.array(depth, np.int32), np.array(label, np.int32),
                   np.array(shorter, np.int32), names)

    def step(self, state: int, word: int) -> int:
        width = len(self.words) + 1
        while True:
            key = state * width + word
            at = int(np.searchsorted(self.keys, key))
            if at < len(self.keys) and self.keys[at] == key:
                return int(self.targets[at])
            if not state:
                return 0
            state = int(self.fail[state])

    def matches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(start, words, label) of every phrase in a sequence of word numbers (0: in no phrase)."""
        state, out = 0, []
        for i, word in enumerate(words):
            state = self.step(state, word) if word else 0
            ends = state if not state or self.label[state] >= 0 else int(self.shorter[state])
            while ends:
                n = int(self.depth[ends])
                out.append((i + 1 - n, n, int(self.label[ends])))
                ends = int(self.shorter[ends])
        return out

    def tags(self, words: list[int]) -> list[tuple[int, int, int]]:
        """The matches that a left-to-right reader takes: the longest at each place, none inside another."""
        longest: dict[int, tuple[int, int]] = {}
        for start, n, label in self.matches(words):
            if n > longest.get(start, (0, 0))[0]:
                longest[start] = (n, label)
        taken, stop = [], 0
        for start in sorted(longest):
            if start >= stop:
                n, label = longest[start]
                taken.append((start, n, label))
                stop = start + n
        return taken

    def spans(self, lists: pa.Array) -> pa.Array:
        """(i, n, label) of the phrases taken in every list of lower-cased words."""
        flat = lists.flatten().dictionary_encode()
        known = np.array([self.words.get(w, 0) for w in flat.dictionary.to_pylist()], np.int64)
        numbers = known[flat.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        stops = np.cumsum(sizes)
        # runs of words that occur in phrases, none across two lists
        found = np.flatnonzero(numbers)
        of = np.searchsorted(stops, found, "right")
        breaks = np.flatnonzero((np.diff(found, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0))
        rows = []
        for a, b in zip(breaks, [*breaks[1:], len(found)]):
            first = int(found[a])
            place = first - int(stops[of[a]] - sizes[of[a]])
            rows += [(int(of[a]), place + start, n, label)
                     for start, n, label in self.tags(numbers[first:first + b - a].tolist())]
        of, i, n, label = np.array(rows, np.int64).reshape(-1, 4).T
        items = pa.StructArray.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(self.labels, pa.string()).take(pa.array(label))],
            names=["i", "n", "label"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), items)


_SPANS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("n", T.IntegerType()),
                                   T.StructField("label", T.StringType())]))


def phrase_table(lexicon: DataFrame) -> DataFrame:
    """``(words, label)``: the different contents of a lexicon (label, content), lower-cased, each with its smallest label."""
    words = F.split(F.lower(trim_ws("content")), rf"[{BLANK}]+")
    return lexicon.select(words.alias("words"), trim_ws("label").alias("label")).where(
        (F.element_at("words", 1) != "") & F.col("label").isNotNull()).groupBy("words").agg(F.min("label").alias("label"))


def _of_table(phrases: DataFrame, max_bytes: int) -> PhraseAutomaton:
    size = phrases.agg(F.sum(F.octet_length(F.concat_ws(" ", "words")) + F.octet_length("label"))).first()[0] or 0
    if size > max_bytes:
        raise TooLarge(f"the phrases have {size} bytes, more than {max_bytes}")
    return PhraseAutomaton.of([(r.words, r.label) for r in phrases.collect()])


def automaton(lexicon: DataFrame, max_bytes: int = MAX_BYTES) -> PhraseAutomaton:
    """The automaton of the contents of a lexicon (label, content).

    Its size is measured first: it goes to every worker, and :class:`TooLarge` is raised over
    ``max_bytes`` of different phrases.
    """
    return _of_table(phrase_table(lexicon), max_bytes)


def fitted(lexicon: DataFrame, max_bytes: int = MAX_BYTES) -> PhraseAutomaton | DataFrame:
    """The automaton of a lexicon, or over ``max_bytes`` its phrases as a written table, for :func:`dealt_spans`."""
    phrases = written(phrase_table(lexicon))
    try:
        return _of_table(phrases, max_bytes)
    except TooLarge:
        return phrases


def _hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words per list) of lists of words; a word is hashed once."""
    flat = lists.flatten().dictionary_encode()
    of_word = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                        for w in flat.dictionary.to_pylist()], np.uint64)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return of_word[flat.indices.to_numpy()] if len(of_word) else of_word, sizes


def _more(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1)


def heads(lists: pa.Array) -> pa.Array:
    """Keys of the first 1 to HEAD_WORDS words from every place of the lists, each once in a list."""
    word, sizes = _hashes(lists)
    of = np.repeat(np.arange(len(sizes)), sizes)
    key, keys, owner = word, [word], [of]
    for k in range(1, HEAD_WORDS):
        key = _more(key[:max(len(word) - k, 0)], word[k:])
        inside = of[:len(key)] == of[k:]
        keys.append(key[inside]), owner.append(of[:len(key)][inside])
    key, of = np.concatenate(keys).view(np.int64), np.concatenate(owner)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[fresh]))


def head(lists: pa.Array) -> pa.Array:
    """The key of :func:`heads` under which a phrase (a list of one word or more) is dealt."""
    word, sizes = _hashes(lists)
    first = np.cumsum(sizes) - sizes
    key = word[first]
    for k in range(1, HEAD_WORDS):
        longer = sizes > k
        key = np.where(longer, _more(key, word[np.where(longer, first + k, first)]), key)
    return pa.array(key.view(np.int64))


def dealt_spans(docs: DataFrame, phrases: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """:func:`phrase_spans` with a phrase table ``(words, label)`` of any size.

    Documents are dealt into parts of about ``part_bytes`` of text.  A part's task builds the automaton of the
    phrases whose first HEAD_WORDS words (all, of a shorter one) the part holds, by hash: no others can occur in
    it.  So its size follows the part's text, and the shuffled rows the words of all texts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64(*dict.fromkeys([*keys, "text"])), F.lit(max(1, -(-size // part_bytes))))
    cut = docs.select(*keys, part.alias("_part"), tok.piece_arrays(F.col("text")).alias("_t"))
    cut = cut.select("*", F.transform("_t", lambda t: F.lower(t["w"])).alias("_w"))
    held = cut.select("_part", F.explode(F.arrow_udf(heads, T.ArrayType(T.LongType()))(F.col("_w"))).alias("_key")).distinct()
    named = phrases.select("words", "label", F.arrow_udf(head, T.LongType())(F.col("words")).alias("_key"))
    mine = held.join(named, "_key").select(F.col("_part").alias("_of"), "words", "label")
    names = [*keys, "_t"]

    def run(of: pa.Table, found: pa.Table) -> pa.Table:
        phrases_here = PhraseAutomaton.of(list(zip(found["words"].to_pylist(), found["label"].to_pylist())))
        spans = [phrases_here.spans(x) for x in of["_w"].chunks]
        return of.select(names).append_column("_p", pa.chunked_array(spans, phrases_here.spans(pa.array([], pa.list_(pa.string()))).type))

    schema = T.StructType([*cut.select(*names).schema.fields, T.StructField("_p", _SPANS)])
    return cut.groupBy("_part").cogroup(mine.groupBy("_of")).applyInArrow(run, schema)


def phrase_spans(docs: DataFrame, phrases: PhraseAutomaton | DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``_t`` (tokens of the text, ``array<struct<s,e,w>>``) and ``_p`` (the phrases taken, as
    ``array<struct<i,n,label>>``); both empty for a null or blank text.  ``phrases`` as :func:`fitted` gives them."""
    if isinstance(phrases, DataFrame):
        return dealt_spans(docs, phrases, keys)
    spans = F.arrow_udf(phrases.spans, _SPANS)
    cut = docs.select(*keys, tok.piece_arrays(F.col("text")).alias("_t"))
    return cut.select(*keys, "_t", spans(F.transform("_t", lambda t: F.lower(t["w"]))).alias("_p"))


def tag_documents(docs: DataFrame, phrases: PhraseAutomaton | DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """``(doc_id, i, s, e, w, tag, score)`` as :func:`spanlab.operators.annotate.lexicon_tag` gives, row-local
    with an automaton."""
    # a tag per token of the phrases, in order; tokens between them are O
    inside = F.flatten(F.transform("_p", lambda p: F.transform(
        F.sequence(F.lit(0), p["n"] - 1),
        lambda k: F.struct((p["i"] + k).alias("i"), F.concat(F.when(k == 0, "B-").otherwise("I-"), p["label"]).alias("tag")))))
    tags = F.map_from_entries(inside)
    rows = phrase_spans(docs, phrases, [doc_col]).select(doc_col, tags.alias("_m"), F.posexplode("_t").alias("i", "_t"))
    return rows.select(doc_col, "i", "_t.s", "_t.e", "_t.w", F.coalesce(F.element_at("_m", F.col("i")), F.lit("O")).alias("tag"),
                       F.lit(1.0).alias("score"))


def exact_entities(docs: DataFrame, phrases: PhraseAutomaton | DataFrame, link_index: DataFrame | None = None,
                   doc_col: str = "doc_id") -> DataFrame:
    """Entities of every document, one row each: ``(doc_id, start, end, label, score, text, icdo_code, match)``.

    The result of :func:`spanlab.operators.annotate.entity_rows` without the fuzzy join, by
    projections and one equi-join to ``link_index``; with an automaton ``docs`` may be a stream (append mode).
    """
    found = phrase_spans(docs.where(~is_blank("text")), phrases, [doc_col, "text"])
    at = lambda i: F.get(F.col("_t"), i)
    spans = F.transform("_p", lambda p: F.struct(
        at(p["i"])["s"].alias("start"), at(p["i"] + p["n"] - 1)["e"].alias("end"), p["label"].alias("label")))
    rows = found.select(doc_col, "text", F.explode(spans).alias("_x")).select(
        doc_col, "_x.start", "_x.end", "_x.label", F.lit(1.0).alias("score"),
        text_slice("text", "_x.start", "_x.end").alias("text"))
    if link_index is None:
        return rows.withColumns({"icdo_code": F.lit(None).cast("string"), "match": F.lit(None).cast("string")})
    linked = link_exact(rows, link_index)
    return linked.select(doc_col, "start", "end", "label", "score", "text", F.col("code").alias("icdo_code"),
                         F.when(F.col("code").isNotNull(), "exact").alias("match"))


def annotate_stream_exact(stream: DataFrame, phrases: PhraseAutomaton, link_index: DataFrame | None,
                          doc_col: str = "doc_id") -> DataFrame:
    """A streaming DataFrame of :func:`exact_entities`: stateless, for append mode and any sink."""
    if not stream.isStreaming:
        raise ValueError("annotate_stream_exact needs a streaming DataFrame")
    return exact_entities(stream, phrases, link_index, doc_col)
