"""Broken prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm import langs
from stepweave.llm.truncation import judged_ends

#: A response is a copy when the prompt as dictionary saves all but this share of its compressed size.
COPY_SHARE = 0.3
#: Bytes that any zstandard frame has beside its content, as measured on an empty text with a dictionary.
FRAME = 9

# What stands where an answer is missing.
_PLACEHOLDERS = {"", "n/a", "na", "null", "none", "nil", "nan", "undefined", "tbd", "todo", "无", "暂无", "空", "[]", "{}"}
# Phrases that decline, by language.
_REFUSALS = [
    r"\bi(?:'m| am) sorry,? but i (?:can(?:'t|not)|am unable)", r"\b(?:am|are|'m|'re) (?:not able|unable) to (?:assist|help|do|complete|work|fulfil|process|handle)", r"\bi (?:can(?:'t|not)|won't|will not) (?:help|assist|do that|do this|comply|be able|complete|fulfil|work on)",
    r"\bi(?:'d| would) rather not\b", r"\bi (?:have|need|must) to? ?(?:decline|refuse)\b", r"\bi (?:must )?(?:decline|refuse)\b", r"\bsomething i can(?:'t|not) do\b", r"\bwon't be able to\b", r"\bagainst my (?:guidelines|policy|policies|rules)\b", r"\bask someone else\b",
    r"\b(?:leider )?(?:ablehnen|verweigern)\b", r"\bkann ich (?:ihnen |dir |euch )?(?:leider |dabei )?nicht (?:helfen|weiterhelfen|tun|bearbeiten|ausführen)", r"\b(?:dabei|damit) kann ich (?:leider )?nicht", r"\bdarf ich (?:so etwas |das |dies )?nicht", r"\btut mir leid\b",
    r"\bje (?:suis désolée?|regrette)\b", r"\b(?:malheureusement )?refuser\b", r"\bne (?:peux|puis) pas (?:vous )?aider", r"\bpas (?:autorisée?|en mesure)\b",
    r"\blo siento\b", r"\bno puedo (?:ayudar|hacer|atender|realizar|aceptar|modificar|tratar)", r"\b(?:tengo que|debo) (?:rechazar|negarme|declinar)", r"\brechazar esta\b", r"\bno (?:me está permitido|estoy autorizad[oa])\b",
    r"\bmi dispiace\b", r"\bnon posso (?:aiutar|fare|svolgere)", r"\bdevo rifiutare\b", r"\bnão posso (?:ajudar|fazer)", r"\bsinto muito\b", r"\btenho de recusar\b", r"\bhet spijt me\b", r"\bк сожалению\b", r"\bне могу\b",
    r"抱歉|很遗憾|对不起", r"无法(?:帮助|完成|协助|处理|提供|回答)", r"不能(?:处理|帮助|协助|完成|提供|修改)", r"不便(?:修改|处理|回答|协助|提供)", r"(?:请联系|请找)(?:其他|别)人",
]
# The same in parts that follow each other within a sentence.
_REFUSALS_IN_PARTS = [
    (r"\bas an? (?:ai|assistant|language model)\b", r"\b(?:can(?:'t|not)|decline|unable|refuse|not)\b"),
    (r"\bich kann (?:das|dies|diese|ihnen|dir)", r"\bnicht\b"),
    (r"\bje ne (?:peux|pourrai|suis)", r"\bpas\b", r"\b(?:aider|traiter|faire|répondre|réaliser|accepter|mesure|autorisée?|modifier)"),
    (r"\bik kan (?:je|u|hier|dit)", r"\bniet\b"),
]
# Courtesies that may stand beside a refusal.
_COURTESIES = [
    r"^no[.!,]?$", r"^nein[.!,]?$", r"^non[.!,]?$", r"anything else\b.*\?$", r"sonst noch\b.*\?$", r"autre (?:question|chose)\b.*\?$", r"algo más\b.*\?$", r"其他问题", r"还有什么", r"\bask someone else\b", r"^(?:thank|thanks|danke|merci|gracias|谢谢)", r"^(?:please|bitte|por favor|veuillez|请)\b.*(?:someone|jemand|quelqu|otra persona|其他人)", r"\?$",
]
# Words of an instruction that itself asks for a refusal.
_ASKS_REFUSAL = re.compile(r"\b(?:declin\w*|turn(?:s|ed|ing)? down|refus\w+|reject\w*|say(?:s|ing)? no|ablehn\w*|absag\w*|zurückweis\w*|décline\w*|rechaz\w*|rifiut\w*|recus\w*|afwijz\w*)\b|拒绝|谢绝|婉拒|回绝", re.I)
# How an instruction asks for a language.
_ASKS_LANGUAGE = re.compile(r"\b(?:in|auf|en|em|op|into|to|ins|na|по)[ -](\w+)|用\s*(\w{1,4}?[语文])|(\w+[语文])(?:回答|回复|作答)", re.I)

_REFUSAL = re.compile("|".join(_REFUSALS), re.I)
_IN_PARTS = [[re.compile(p, re.I) for p in parts] for parts in _REFUSALS_IN_PARTS]
_COURTESY = re.compile("|".join(_COURTESIES), re.I)
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"<[^<>]*>")
_LABEL = re.compile(r"^\s*(?:step\s+\d+\s*:?|thought\s*:|instruction\s*:|answer\s*:|response\s*:|task\s*:|question\s*:)\s*", re.I)
_EVIDENCE = re.compile(r"^\s*(?:action|observation)\s*:", re.I)
_STEP = re.compile(r"(?:\A|\n)\s*step\s+\d+\s*:", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_PATH = re.compile(r"https?://\S+|(?<!\S)[^\s/]*\w/[\w./-]+|\b[^\W_]+_\w+\b|`[^`\n]*`|(?<!\S)[^\s@]+@\S+")


_OTHER = re.compile(r"[\W_]+")
_UNSEEN = regex.compile(r"(?!\n)[\p{Cf}\p{Cc}]")


def _bare(text: str) -> str:
    """Letters and digits only, in one form and case."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


@lru_cache(16)
def _content(response: str) -> list[str]:
    """The lines of the answer without labels; lines of actions and observations without content are gone."""
    lines = []
    for line in _CODE.sub(lambda m: "\n" + m.group().replace("\n", " ") + "\n", response).split("\n"):
        before = None
        while before != line:
            before, line = line, _LABEL.sub("", line)
        if _bare(_EVIDENCE.sub("", line)):
            lines.append(line.strip())
    return lines


def is_empty(response: str | None) -> bool:
    """Whether no line holds anything beyond labels, markup, punctuation and words for nothing."""
    if response is None:
        return True
    kept = _TAG.sub("", response.replace("&nbsp;", " "))
    kept = _UNSEEN.sub("", kept).strip().strip("\"'").strip()
    return kept.casefold() in _PLACEHOLDERS or not _bare("\n".join(_content(kept)))


def is_copy(instruction: str, response: str) -> bool:
    """Whether the response has nothing that the prompt lacks, by its size under zstandard with the prompt as dictionary.

    A dictionary needs 8 bytes: shorter prompts are compared as they are. An answer of less than a quarter of the prompt's letters is no copy: it quotes, as answers to questions about a text do, and doesn't repeat the instruction.
    """
    prompt, answer = _bare(instruction).encode(), _bare("\n".join(re.sub(r"^[>\s\"'“”„«»]+", "", x) for x in _content(response))).encode()
    if len(prompt) < 8 or not answer:
        return bool(answer) and prompt == answer
    if 4 * len(answer) < len(prompt):
        return False
    with_prompt = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(answer)
    alone = zstandard.ZstdCompressor(level=9, write_content_size=False).compress(answer)
    first = zstandard.ZstdCompressor(level=9, write_content_size=False).compress(prompt)
    # Alone, a text that repeats itself is small too: the prompt's own size then bounds what one reading of it costs.
    return len(with_prompt) - FRAME <= COPY_SHARE * (max(len(alone), min(len(first), len(alone) * 2)) - FRAME)


def _follow(parts: list[re.Pattern], sentence: str) -> bool:
    """Whether the parts are found one after the other, each at its first place behind the one before."""
    at = 0
    for part in parts:
        m = part.search(sentence, at)
        if not m:
            return False
        at = m.end()
    return True


def is_refusal(instruction: str, response: str) -> bool:
    """Whether every sentence declines or is a courtesy, at least one declines, nothing is done, and the prompt doesn't ask for a text that declines."""
    if _ASKS_REFUSAL.search(instruction):
        return False
    sentences = [s for line in _content(response) for s in _SENTENCE.split(line) if _bare(s)]
    if any(_EVIDENCE.match(s) or s.startswith("```") for s in sentences):
        return False
    declines = [bool(_REFUSAL.search(s)) or any(_follow(parts, s) for parts in _IN_PARTS) for s in sentences]
    return any(declines) and all(d or _COURTESY.search(s.strip()) for d, s in zip(declines, sentences))


def prose(text: str) -> str:
    lines = [x for x in _content(text) if not _EVIDENCE.match(x) and not x.startswith("```")]
    return _PATH.sub(" ", "\n".join(lines))


def in_other_language(instruction: str, response: str) -> bool:
    asked = langs.guess(_PATH.sub(" ", instruction))[0]
    given, evidence = langs.guess(prose(response))
    if asked is None or given is None or asked == given or evidence < 2:
        return False
    wanted = {langs.named_language(w) for m in _ASKS_LANGUAGE.findall(instruction) for w in m if w}
    return given not in wanted


def open_end(response: str) -> bool:
    """Whether a code block doesn't close or the last step has a thought but no action, and nothing after it."""
    if response.count("```") % 2:
        return True
    at = [m.start() for m in _STEP.finditer(response)]
    if not at:
        return False
    last = response[at[-1] :].strip()
    labels = re.findall(r"(?m)^\s*(thought|action|observation)\s*:", last, re.I)
    return not any(x.lower() == "action" for x in labels) and "\n\n" not in last


def _labels(instruction: pd.Series, response: pd.Series) -> pd.DataFrame:
    out = []
    for i, r in zip(instruction, response):
        i = i or ""
        if is_empty(r):
            out.append(("empty", False))
        elif is_refusal(i, r):
            out.append(("refusal", False))
        elif i and is_copy(i, r):
            out.append(("copy", False))
        else:
            out.append(("other_language" if in_other_language(i, r) else None, open_end(r)))
    return pd.DataFrame(out, columns=["defect", "open_end"])


def defective_pairs(records: DataFrame) -> DataFrame:
    """(record_id, defect): one row for each record whose response is unfit, with one of empty, truncated, refusal, copy, other_language.

    ``empty``: null, blank, or only labels, markup, punctuation and words for nothing. ``copy``: zstandard with the prompt as dictionary leaves almost nothing of the response. ``refusal`` and ``other_language`` go by dictionaries of phrases and function words; a language that the prompt asks for is not another one. ``truncated``: the ends of all responses make a model of terminal contexts (see truncation.py), to which come code blocks and steps that don't close. Of several defects the first of empty, refusal, copy, truncated, other_language is given.

    A null instruction can be neither copied nor in another language; rows with a null record_id are left out; rows repeated under one record_id give one row (the least defect by name); an empty table gives none; other columns are not read.
    """
    rows = records.where("record_id IS NOT NULL").select(F.col("record_id").cast("bigint").alias("record_id"), "instruction", F.col("response").alias("text"))
    labels = F.pandas_udf(_labels, "struct<defect:string,open_end:boolean>")
    labelled = rows.withColumn("label", labels("instruction", "text"))
    labelled = labelled.select("record_id", F.col("label.defect").alias("defect"), F.col("label.open_end").alias("open_end"), "text")
    # A null response is empty without further ado; the counts of ends don't need the labels, and so don't make them.
    ends = judged_ends(labelled, ["record_id", "defect", "open_end"])
    over = F.col("cut") | F.col("open_end")
    defect = F.when(F.col("defect").isin("empty", "refusal", "copy"), F.col("defect")).when(over, "truncated").otherwise(F.col("defect"))
    found = ends.select("record_id", defect.alias("defect")).unionByName(rows.where("text IS NULL").select("record_id", F.lit("empty").alias("defect")))
    return found.where("defect IS NOT NULL").groupBy("record_id").agg(F.min("defect").alias("defect"))
