"""The language of every document and of every stretch of it, whatever its label says.

Scripts narrow the candidates of a word; a word model trained here on a bounded sample of labelled rows scores the rest;
Viterbi with a switching penalty labels the words of a document, all documents of a batch in step. Sentences take the
language of most of their words, documents that of most of their prose sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages in use, with frequent function words that start the model.
SEEDS = {
    "de": "der die das und ist nicht auf mit den dem ein eine zu von wurde man",
    "en": "the and of to in is was that on for with not by this as it",
    "es": "el los las la y en que una por con se del de no al su",
    "fr": "le les des la et est que une dans pour sur pas de du au avec",
    "it": "il gli che di è per una con non della la del sono nel si su",
    "ja": "",
    "nl": "de het een en van niet op met dat te voor zijn werd naar is over",
    "pt": "o os as e que em uma não do da de para com foi na no",
    "ru": "и в не на что с по как это из",
}
#: What no language in use explains: other scripts, letters that Russian lacks, words without any evidence.
NONE = "und"
LANGS = (*SEEDS, NONE)
_AT = {x: i for i, x in enumerate(LANGS)}
#: Three-letter codes of these languages (terminological and bibliographic).
THREE = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "jpn": "ja", "nld": "nl", "dut": "nl", "por": "pt", "rus": "ru"}
#: Labelled rows looked at to train: those with the smallest hash of their id, of texts of up to so many characters.
TRAIN_ROWS, TRAIN_CHARS = 5000, 20_000
#: Nats that a change of language must gain.
SWITCH = 5.0
_CLIP = 6.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A sentence ends with a sign and white space or the end; signs inside names and numbers don't end one.
_END = re.compile(r"[.!?…]+[\"'”’»)\]*_]*(?=\s|$)|[。！？]+[」』”）]*")
_PARA = re.compile(r"\r\n|\r|\n")
_QUOTE = re.compile(r"^\s*(?:>+\s*|[*•\-–—+]\s+|<[^<>\s]{1,40}>\s*|\d{1,3}[.)]\s+)+")
#: What marks a line as log, command, path list, table or heading, not prose.
_NOT_PROSE = re.compile(
    r"^\s*(?:[|#=\[{}$]|\d{4}-\d\d-\d\d[T ]\d\d:|(?:[A-Za-z]:\\|/|%\w+%)\S*|\w+=\S+[;,]\w+=|\"?[A-Za-z]:\\|-{3,}|```)"
)
_JA = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿ｦ-ﾟ]")
_KANA = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
#: Cyrillic letters that Russian doesn't have; scripts of none of the languages.
_NOT_RUSSIAN = re.compile(r"[ѐђ-џѠ-ԯ]")
_OTHER = re.compile(r"[\u0370-\u03ff\u0530-\u1cff\u1f00-\u1fff\uac00-\ud7af\ufb1d-\ufdff\ufe70-\ufefc]")
#: Ideographs in a row that Japanese seldom has without kana.
_IDEOGRAPHS = 8
#: A token of letters only, or with inner apostrophes, counts as a word of prose; paths, flags, file names and ids don't.
_TOKEN = re.compile(r"[\"'“”‘’«»(\[*_]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[\"'“”‘’«»)\].,;:!?*_…]*")
_MIN_WORDS = 3
_MIN_JA = 6


def sentences(text: str) -> Iterator[tuple[int, str, bool, int, int]]:
    """(paragraph number, sentence, complete, first line, last line) of the prose of a text; complete ones end with a sign.

    Paragraphs are parted by lines of white space only; they and the lines are numbered from 1. Marks of quotes, lists and
    speakers are taken off the lines, wrapped lines are joined; lines that are no prose part what is around them.
    """
    para, buf, lines, blank = 0, [], [], True
    for at, line in enumerate([*_PARA.split(text), ""], 1):
        if not line.strip():
            if buf:
                yield from _cut(para, buf, lines)
                buf, lines = [], []
            blank = True
            continue
        if blank:
            para, blank = para + 1, False
        plain = _QUOTE.sub("", line)
        spoken = plain is not line and "<" in line[:3]
        if _prose(plain):
            if spoken and buf:
                yield from _cut(para, buf, lines)
                buf, lines = [], []
            buf.append(plain.strip())
            lines.append(at)
        elif buf and plain.strip():
            yield from _cut(para, buf, lines)
            buf, lines = [], []


class _Words(dict):
    """Runs without white space to the word of prose that they are, in lower case and without signs; else the empty string."""

    MOST = 500_000

    def __missing__(self, run: str) -> str:
        out = run.strip("\"'“”‘’«»()[].,;:!?*_…").lower().replace("’", "'") if _TOKEN.fullmatch(run) else ""
        if len(self) >= self.MOST:
            self.clear()
        self[run] = out
        return out


_word_of = _Words()


def _prose(line: str) -> bool:
    if not line.strip() or _NOT_PROSE.match(line):
        return False
    if not line.isascii() and _JA.search(line):
        return True
    parts = line.split()
    return 2 * sum(map(bool, map(_word_of.__getitem__, parts))) >= len(parts)


def _cut(para: int, buf: list[str], lines: list[int]) -> Iterator[tuple[int, str, bool, int, int]]:
    text, at = " ".join(buf), 0
    begins = [0]
    for part in buf[:-1]:
        begins.append(begins[-1] + len(part) + 1)

    def line(place: int) -> int:
        return lines[bisect_right(begins, place) - 1]

    for m in _END.finditer(text):
        s = text[at : m.end()].strip()
        if s:
            yield para, s, True, line(at + (at > 0)), line(m.end() - 1)
        at = m.end()
    if text[at:].strip():
        yield para, text[at:].strip(), False, line(at + (at > 0)), lines[-1]


def prose_words(sentence: str) -> list[str]:
    """The words of a sentence in lower case, without paths, file names, flags and identifiers."""
    if not sentence.isascii() and _JA.search(sentence):
        return [w for w in _WORD.findall(sentence.lower()) if _JA.search(w)]
    return [w for w in map(_word_of.__getitem__, sentence.split()) if w]


def is_full(words: list[str], complete: bool) -> bool:
    """Whether a sentence is a full prose sentence: ended by a sign, and of several words (or signs without spaces)."""
    return complete and (len(words) >= _MIN_WORDS or sum(len(w) for w in words if not w.isascii() and _JA.search(w)) >= _MIN_JA)


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, of the languages in use; case, blanks, region and a three-letter code apart."""
    x = re.split(r"[-_]", (label or "").strip().lower())[0]
    x = THREE.get(x, x)
    return x if x in SEEDS else None


@dataclass
class Model:
    """Log-odds of words against the mean over the languages, and of non-ASCII letters for words never seen."""

    index: dict[str, int]
    scores: np.ndarray
    letters: dict[str, np.ndarray]

    def score(self, word: str) -> np.ndarray:
        if not word.isascii():
            if _OTHER.search(word):
                return _only(NONE)
            if _JA.search(word):
                return _only("ja", -8.0) if _KANA.search(word) else _only("ja", 0.5) if len(word) <= _IDEOGRAPHS else _only(NONE)
            if _CYRILLIC.search(word):
                return _only(NONE if _NOT_RUSSIAN.search(word) else "ru", 1.0)
        i = self.index.get(word)
        if i is not None:
            return self.scores[i]
        if "'" in word:
            head, _, tail = word.partition("'")
            parts = [self.index[p] for p in (head, head + "'", tail) if p in self.index]
            if parts:
                return np.clip(self.scores[parts].sum(0), -_CLIP, _CLIP)
        if not word.isascii():
            hits = [self.letters[ch] for ch in word if ch in self.letters]
            if hits:
                return np.clip(np.sum(hits, 0), -3, 3) + _LATIN
        return _LATIN


def _only(lang: str, none: float = 0.0) -> np.ndarray:
    """For one language; `none` says how much the word would suit an unknown one."""
    out = np.full(len(LANGS), -8.0)
    out[_AT[NONE]] = none
    out[_AT[lang]] = 2.0
    return out


#: No opinion: a word of Latin letters; what has no evidence at all is undetermined.
_LATIN = np.zeros(len(LANGS))
_LATIN[[_AT["ja"], _AT["ru"]]] = -8.0
_LATIN[_AT[NONE]] = 0.01


def _estimate(counts: dict[str, np.ndarray]) -> Model:
    total = np.zeros(len(LANGS))
    for c in counts.values():
        total += c
    latin = [i for i, x in enumerate(LANGS) if x not in ("ja", "ru", NONE)]
    kept = sorted(counts)
    letters: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    scores = np.zeros((len(kept), len(LANGS)))
    typical = max(total[latin].max(), 1.0)
    for i, w in enumerate(kept):
        # Rates per language at a common size; a share of the word's mean smooths rare words towards no opinion.
        rate = counts[w] * typical / np.maximum(total, typical / 50)
        mean = rate[latin].mean()
        logs = np.log(rate + 0.1 * mean + 0.5)
        scores[i] = np.clip(logs - logs[latin].mean(), -_CLIP, _CLIP) + np.minimum(_LATIN, 0)
        if not w.isascii():
            for ch in set(w):
                if not ch.isascii():
                    letters[ch] += rate
    by_letter = {}
    for ch, rate in letters.items():
        logs = np.log(rate + 0.02 * rate.sum() + 0.5)
        by_letter[ch] = np.clip(logs - logs[latin].mean(), -3, 3)
    return Model({w: i for i, w in enumerate(kept)}, scores, by_letter)


def train(rows: list[tuple[str | None, str | None]], rounds: int = 3) -> Model:
    """A word model from (label, text) rows: seeded, then re-estimated on sentences as the model itself labels them.

    Labels only tip the scales, less from round to round, so wrong ones lose against a sentence's own words.
    """
    seeds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    for lang, ws in SEEDS.items():
        for w in ws.split():
            seeds[w][_AT[lang]] += 20
    model = _estimate(dict(seeds))
    code: dict[str, int] = {}
    seq, sizes, labels = [], [], []
    for label, text in rows:
        lang = label_code(label)
        for _, s, *_ in sentences(text) if text else ():
            if ws := prose_words(s):
                seq += [code.setdefault(w, len(code)) for w in ws]
                sizes.append(len(ws))
                labels.append(-1 if lang is None else _AT[lang])
    if not seq:
        return model
    seq, sizes, labels = np.array(seq), np.array(sizes), np.array(labels)
    starts, names = np.cumsum(sizes) - sizes, list(code)
    for r in range(rounds):
        total = np.add.reduceat(np.array([model.score(w) for w in names])[seq], starts)
        told = np.flatnonzero(labels >= 0)
        total[told, labels[told]] += (3.0, 1.0, 0.0)[min(r, 2)]
        best, order = total.argmax(1), np.sort(total, 1)
        sure = order[:, -1] - order[:, -2] >= 1.0
        lang_of = np.repeat(best, sizes)
        kept = np.repeat(sure, sizes)
        table = np.bincount(seq[kept] * len(LANGS) + lang_of[kept], minlength=len(names) * len(LANGS)).reshape(-1, len(LANGS)).astype(float)
        counts = {w: table[i] for w, i in code.items()}
        for w, c in seeds.items():
            counts[w] = counts.get(w, 0) + c / 10
        model = _estimate({w: c for w, c in counts.items() if c.sum() > 0})
    return model


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best state of every word; sequences are scores[start:start+length], all taken in step, long ones last."""
    n, k = scores.shape
    out = np.zeros(n, np.int8)
    if not n:
        return out
    stay = np.zeros((n, k), bool)
    best_prev = np.zeros(n, np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = int((lengths > 0).sum())
    v = scores[starts[:live]].copy()
    finals = np.zeros((live, k))
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths[:live], -np.arange(1, longest + 1), "right")  # sequences longer than t-1
    for t in range(1, longest):
        m = int(alive[t])
        finals[m : len(v)] = v[m:]
        v = v[:m]
        top = v.argmax(1)
        high = v[np.arange(m), top] - penalty
        at = starts[:m] + t
        keep = v >= high[:, None]
        stay[at], best_prev[at] = keep, top
        v = np.where(keep, v, high[:, None]) + scores[at]
    finals[: len(v)] = v
    state = finals.argmax(1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        m = int(alive[t])
        at = starts[:m] + t
        out[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], best_prev[at])
    return out


_SCHEMA = "doc_id bigint, para_no bigint, lang string, sentences int, words int, confidence double, main boolean"
_SEGMENTS = "doc_id bigint, segment_no int, para_no bigint, first_line int, last_line int, lang string, words int, confidence double"


def _slices(batches: Iterator[pa.RecordBatch], rows_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that rows_of(ids, texts) makes of slices of (doc_id, text) batches, so that very long texts don't pile up."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(texts):
            size, z = 0, at
            while z < len(texts) and (z == at or size + len(texts[z] or "") <= 4_000_000):
                size += len(texts[z] or "")
                z += 1
            rows = rows_of(ids[at:z], texts[at:z])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            at = z


@dataclass
class _Labelled:
    """The words of a slice of documents by sentence, with the Viterbi state of each."""

    sent: list[tuple[int, int, int, bool, int, int]]  # document, paragraph, words, full, first line, last line
    scores: np.ndarray
    path: np.ndarray
    starts: np.ndarray

    def confidence(self, starts: np.ndarray, sizes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The model's probability of a language for runs of words, evened out by length."""
        soft = np.add.reduceat(self.scores, starts) / np.sqrt(sizes)[:, None]
        soft = np.exp(soft - soft.max(1, keepdims=True))
        return soft[np.arange(len(sizes)), lang] / soft.sum(1)


def _label(model: Model, texts: list[str | None]) -> _Labelled | None:
    """All prose sentences with words, full or not; None if there are none."""
    code: dict[str, int] = {}
    seq: list[int] = []
    sent = []
    n_doc = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for para, s, complete, first, last in sentences(t) if t else ():
            if ws := prose_words(s):
                seq += [code.setdefault(w, len(code)) for w in ws]
                sent.append((i, para, len(ws), is_full(ws, complete), first, last))
                n_doc[i] += len(ws)
    if not sent:
        return None
    scores = np.array([model.score(w) for w in code])[np.array(seq)]
    n = np.array([x[2] for x in sent])
    return _Labelled(sent, scores, viterbi(scores, np.cumsum(n_doc) - n_doc, n_doc), np.cumsum(n) - n)


def labeller(model: Model):
    """The mapInArrow function (doc_id, text) to languages of documents and paragraphs; see label_spans."""

    def rows_of(ids, texts):
        got = _label(model, texts)
        groups: dict[int, dict[tuple[int, int], list[float]]] = defaultdict(dict)
        if got:
            n = np.array([x[2] for x in got.sent])
            votes = np.add.reduceat(np.eye(len(LANGS))[got.path], got.starts)
            lang = (votes + 1e-6 * np.add.reduceat(got.scores, got.starts)).argmax(1)
            conf = got.confidence(got.starts, n, lang)
            full = {x[0] for x in got.sent if x[3]}
            for (i, para, m, whole, _, _), g, c in zip(got.sent, lang.tolist(), conf.tolist(), strict=True):
                if whole or i not in full:  # broken sentences only count where there are no others
                    e = groups[i].setdefault((para, g), [0, 0, 0.0, 0])
                    for k, x in enumerate((1, m, c, whole)):
                        e[k] += x
        out = []
        for i, doc in enumerate(ids):
            total, weight, full_ones, sure = Counter(), Counter(), Counter(), Counter()
            for (_, g), (k, m, c, f) in groups[i].items():
                total[g] += k
                weight[g] += m
                full_ones[g] += f
                sure[g] += c
            known = [g for g in total if LANGS[g] != NONE] or list(total)
            if not known:
                out.append((doc, 0, NONE, 0, 0, 0.0, True))
                continue
            main = max(known, key=lambda g: (total[g], weight[g], -g))
            out.append((doc, 0, LANGS[main], full_ones[main], weight[main], sure[main] / sum(total.values()), True))
            out += [(doc, para, LANGS[g], f, m, c / k, g == main) for (para, g), (k, m, c, f) in groups[i].items()]
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("para_no", pa.int64()), ("lang", pa.string()), ("sentences", pa.int32()), ("words", pa.int32()), ("confidence", pa.float64()), ("main", pa.bool_())])
    return lambda batches: _slices(batches, rows_of, schema)


def segmenter(model: Model):
    """The mapInArrow function (doc_id, text) to stretches of one language; see label_segments."""

    def rows_of(ids, texts):
        got = _label(model, texts)
        if not got:
            return []
        n = np.array([x[2] for x in got.sent])
        doc = np.repeat([x[0] for x in got.sent], n)
        of = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.concatenate([[True], (got.path[1:] != got.path[:-1]) | (doc[1:] != doc[:-1])]))
        sizes = np.diff(np.concatenate([at, [len(doc)]]))
        lang = got.path[at].astype(int)
        conf = got.confidence(at, sizes, lang)
        out, now, no = [], -1, 0
        for a, m, g, c in zip(at.tolist(), sizes.tolist(), lang.tolist(), conf.tolist(), strict=True):
            first, last = got.sent[of[a]], got.sent[of[a + m - 1]]
            no = no + 1 if first[0] == now else 1
            now = first[0]
            out.append((ids[now], no, first[1], first[4], last[5], LANGS[g], m, c))
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("segment_no", pa.int32()), ("para_no", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())])
    return lambda batches: _slices(batches, rows_of, schema)


def training_rows(docs: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[str | None, str | None]]:
    """Up to `limit` labelled rows, those with the smallest hash of their id, of texts of up to TRAIN_CHARS characters."""
    label = F.lower(F.split(F.trim("lang"), "[-_]")[0])
    known = docs.where(label.isin(*SEEDS, *THREE) & (F.length("text") <= TRAIN_CHARS)).select("lang", "text", F.xxhash64("doc_id").alias("_h"))
    # Hashes first, so that no text is brought to the driver that isn't kept.
    last = known.select("_h").orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]
    return [(r[0], r[1]) for r in known.where(F.col("_h") <= last).limit(limit).collect()] if last is not None else []


def label_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of every document and paragraph: doc_id, para_no, lang, sentences, words, confidence, main.

    para_no 0 is the document: its main language, that of most of its full prose sentences (then of most words), with the
    share of those sentences in its confidence. Other rows hold, for each paragraph and language, the number of its full prose
    sentences; main tells whether the language is the document's. Where no sentence is full, broken ones decide, and sentences
    is 0. What no language in use explains is `und`; a document without prose, an empty and a null text have that one row,
    with confidence 0. Whole texts are read. Extra columns are ignored; rows with equal or null doc_id are labelled each by
    itself.
    """
    model = model or train(training_rows(docs))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(labeller(model), _SCHEMA)


def label_segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every stretch of prose in one language: doc_id, segment_no, para_no, first_line, last_line, lang, words, confidence.

    A stretch is a longest run of words that the best path gives one language, in full sentences or not; it may begin and end inside
    a line. para_no is the paragraph it begins in; lines and paragraphs are numbered from 1. Documents without prose have no rows.
    """
    model = model or train(training_rows(docs))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(segmenter(model), _SEGMENTS)


def _wrong(lang: Column, found: Column) -> Column:
    x = F.lower(F.split(F.regexp_replace(F.coalesce(lang, F.lit("")), r"(?U)^\s+|\s+$", ""), "[-_]")[0])
    codes = F.create_map(*[F.lit(y) for pair in THREE.items() for y in pair])
    return F.coalesce(F.try_element_at(codes, x), x) != found


def languages_found(docs: DataFrame) -> DataFrame:
    """p9_found: (doc_id, para_no, found_lang)."""
    model = train(training_rows(docs))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    run = labeller(model)

    def keep_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Documents go by their place in the batch, as ids may repeat.
        for b in batches:
            place = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(1)], names=["doc_id", "text"])
            for out in run(iter([place])):
                yield pa.RecordBatch.from_arrays([b.column(0).take(out.column(0)), *out.columns[1:], b.column(2).take(out.column(0))], names=[*out.schema.names, "label"])

    spans = d.mapInArrow(keep_label, _SCHEMA + ", label string")
    case = F.when(F.col("para_no") == 0, _wrong(F.col("label"), F.col("lang"))).otherwise(~F.col("main"))
    return spans.where(case & (F.col("sentences") > 0) & (F.col("lang") != NONE)).select("doc_id", "para_no", F.col("lang").alias("found_lang")).distinct()

