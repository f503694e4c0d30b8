"""Languages of documents and of the segments of mixed ones."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm import crf, langs

#: Labelled documents the model is trained on, at most: those whose hash comes first.
TRAINING_DOCUMENTS = 4000
#: Words of such a document that are used, at most; the others train nothing more.
TRAINING_WORDS = 120
#: Words a sentence needs to stand in a language of its own.
LEAST_WORDS = 2
#: Log odds by which a sentence's own words must favour its language before it breaks a run.
LEAST_LEAD = 2.0

_TAG = re.compile(r"<[^<>]*>|&#?\w{1,8};")
_NOISE = re.compile(r"https?://\S+|www\.\S+|(?<!\S)[^\s@]+@\S+\.\S+|[#@]\w+")
_BORDER = re.compile(r"[.!?…。！？；\n\r]+|\s[/|•·—–-]\s|[|•]")
_PIECE = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+(?:['’][^\W\d_㐀-䶿一-鿿]+)*")
_JOINT = re.compile(r"['’]")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of the sentences that have words; markup, addresses and handles are passed over. Han text goes by character."""
    clean = _NOISE.sub(_blank, _TAG.sub(_blank, text))
    out, at = [], 0
    joined = "'" in clean or "’" in clean
    for stop, nxt in [(m.start(), m.end()) for m in _BORDER.finditer(clean)] + [(len(clean), len(clean))]:
        words = _PIECE.findall(clean[at:stop].lower())
        if joined:
            words = [p for w in words for p in _JOINT.split(w) if p]
        if words:
            out.append((at, stop, words))
        at = nxt
    return out


def training_texts(rows: list[tuple[str, str]], seed: int = 7) -> list[list[tuple[list[str], str]]]:
    """Texts in one language, by label and dictionary alike, and as many made of two parts of such texts, from which the transitions over sentence borders are learned."""
    pure: list[list[tuple[list[str], str]]] = []
    for text, lang in rows:
        parts, used = [], 0
        for start, end, words in sentences(text):
            if used >= TRAINING_WORDS:
                break
            guessed, evidence = langs.guess(text[start:end])
            if guessed not in (None, lang) and evidence > 1:
                parts = []
                break
            parts.append((words[:TRAINING_WORDS], lang))
            used += len(words)
        if parts:
            pure.append(parts)
    rng = random.Random(seed)
    mixed = []
    for a in pure:
        b = rng.choice(pure)
        cut, keep = rng.randint(1, len(a)), rng.randint(1, len(b))
        mixed.append(a[:cut] + b[:keep])
    return pure + mixed


def train_model(documents: DataFrame, limit: int = TRAINING_DOCUMENTS) -> crf.Crf:
    """The model from at most ``limit`` labelled documents, a like number of each language, chosen by hash."""
    named = {name: code for code, names in langs.NAMES.items() if code in langs.LANGUAGES for name in names.split()}
    base = F.split(F.regexp_replace(F.lower(F.trim("lang")), "_", "-"), "[-.@ (]")[0]
    code = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").select(F.try_element_at(code, base).alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h")).where("lang IS NOT NULL")
    share = limit // len(langs.LANGUAGES)
    # A bounded sample in one reading: of each language twice its share, so that rows stored twice don't count twice, and of each text no more than the words that may train.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = rows.withColumn("rn", first).where(F.col("rn") <= 2 * share).select("lang", "h", F.substring("text", 1, 12 * TRAINING_WORDS).alias("text")).collect()
    chosen: list[tuple[str, str]] = []
    for lang in langs.LANGUAGES:
        own = dict(sorted((r["h"], r["text"]) for r in picked if r["lang"] == lang))
        chosen += [(text, lang) for text in list(own.values())[:share]]
    return crf.train(training_texts(chosen))


def segments_of(parts: list[tuple[int, int, list[str]]], labels: list[tuple[str, float, float]]) -> list[tuple[str, float, int, int]]:
    """Runs of sentences in one language: (language, mean confidence by words, start, end)."""
    solid = [len(words) >= LEAST_WORDS and lead >= LEAST_LEAD for (_, _, words), (_, _, lead) in zip(parts, labels)]
    if not any(solid):
        # A text without any clear sentence has the language that most of its words have.
        weight: dict[str, float] = {}
        for (_, _, words), (lang, p, _) in zip(parts, labels):
            weight[lang] = weight.get(lang, 0.0) + p * len(words)
        best = max(sorted(weight), key=weight.get)
        n = sum(len(words) for _, _, words in parts)
        return [(best, weight[best] / n, parts[0][0], parts[-1][1])]
    runs: list[list] = []
    waiting: list[tuple[int, int, int]] = []
    for (start, end, words), (lang, p, _), sure in zip(parts, labels, solid):
        if not sure:
            # Names and single words go with the sentence before them, at the beginning with the first clear one.
            if runs:
                runs[-1][4] = end
            else:
                waiting.append((start, end, len(words)))
        elif runs and runs[-1][0] == lang:
            runs[-1][1] += p * len(words)
            runs[-1][2] += len(words)
            runs[-1][4] = end
        else:
            runs.append([lang, p * len(words), len(words), waiting[0][0] if waiting else start, end])
            waiting = []
    return [(lang, total / n, start, end) for lang, total, n, start, end in runs]


_SEGMENT = "doc_id bigint, seg_no bigint, lang string, confidence double, start int, end int, n_segments int, right_label boolean"


def _segments(model: crf.Crf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in batches:
            out = []
            parts = [sentences(t) for t in batch["text"]]
            labels = crf.label(model, score, [[words for _, _, words in p] for p in parts])
            for doc, tag, p, l in zip(batch["doc_id"], batch["lang"], parts, labels):
                if not p:
                    continue
                found = segments_of(p, l)
                right = len(found) == 1 and langs.named_language(tag) == found[0][0]
                out += [(doc, i, lang, round(confidence, 6), start, end, len(found), right) for i, (lang, confidence, start, end) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence", "start", "end", "n_segments", "right_label"])

    return run


def document_segments(documents: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, start, end, n_segments, right_label): every segment of every document that has words.

    A conditional random field labels the words by forward-backward; a sentence has the language of its words' mean probability, a segment is the longest run of sentences in one language, and ``start`` and ``end`` are characters of the text. Whole texts are read, at one batch's memory. Null, blank and wordless texts and null ids give no row; equal rows give theirs once; an empty table gives no row (and an untrained model); columns other than doc_id, text and lang are not read. The model is trained on a bounded sample (TRAINING_DOCUMENTS).
    """
    model = model or train_model(documents)
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    return rows.mapInPandas(_segments(model), _SEGMENT)


def mislabelled(documents: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """(doc_id, seg_no, lang): the segments of documents whose label is missing or wrong, and of all documents in several languages."""
    return document_segments(documents, model).where("n_segments > 1 OR NOT right_label").select("doc_id", "seg_no", "lang").distinct()
