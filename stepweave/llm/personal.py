"""Personal values inside free text: found by labelers that vote, replaced by typed placeholders."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import deepjson
from stepweave.runtime import cut

KINDS = ("email", "phone", "id_number", "address", "name")
#: Different candidates of a kind that train the final classifier, at most: those whose hash comes first.
TRAINING_SPANS = 20_000
BUCKETS = 1 << 13
#: Weight of the expectation that a labeler is right, as a share of the evidence on it, alike at every size.
PRIOR_SHARE = 0.5

# Pieces of the patterns.
_TOKEN = r"(?:(?:[OD]['’])?\p{Lu}[\p{Ll}’']+(?:\p{Lu}\p{Ll}+)?|(?:[OD]['’])?\p{Lu}{2,})"
_WORD = rf"{_TOKEN}(?:-{_TOKEN})*"
_PARTICLE = r"(?:(?i:van|von|vom|zu|de|della|di|da|del|dos|du|la|le|der|den|ter|ten|el|al|bin|ibn|mac|mc) )"
_TOWN = r"\p{Lu}[\p{L}'’]+(?:[ -]\p{Lu}[\p{L}'’]+)*"
_NO = r"(?<![\p{Latin}\d])"
_END = r"(?![\p{Latin}\d])"
_AT = r"(?:@|＠|\s?[(\[{]\s?(?:at|AT|At)\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|DOT)\s?[)\]]\s?)"
_EMAIL = regex.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9@])")
_NUMBER = regex.compile(r"(?<![\p{Latin}\d_@.#/+-])(?:\+|\(\+?)?[A-Z]{0,2}\d(?:[\d() ./-]*[\d])?[A-Z]?(?![\p{Latin}\d_@])")
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Court|Ct\.?|Close|Crescent|Boulevard|Blvd\.?|Square|Sq\.?|Place|Pl\.?|Terrace|Row|Hill)"
_ADDRESSES = [
    rf"{_NO}(?:(?i:Flat|Apt\.?|Unit|Apartment|Suite) \d+\w?, ?)?\d+ ?[A-Za-z]?(?: bis)? {_WORD}(?: {_WORD})* {_STREET},? {_TOWN}(?:, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?| [A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|,? \d{{4,5}})?{_END}",
    rf"{_NO}(?:\p{{Lu}}[\p{{L}}'’-]* )?\p{{Lu}}?[\p{{L}}'’-]*(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Gg]asse|[Pp]latz|[Aa]llee|[Rr]ing|[Dd]amm|[Uu]fer|[Hh]of|straat|laan) \d+ ?[a-z]?, (?:[A-Z]{{1,2}}-)?\d{{4,5}}(?: [A-Z]{{2}})? {_TOWN}{_END}",
    rf"{_NO}\d+(?: ?[a-z]| (?:bis|ter|quater))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route) (?:(?:des|de la|du|de|d['’]|de l['’]|le|la|les) ?)?{_TOWN}, (?:F-)?\d{{5}} {_TOWN}{_END}",
    rf"{_NO}(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Via|Viale|Piazza|Corso|Rua|Travessa) (?:(?:de la|de los|de las|del|de|dei|della|da|do|dos) )?{_TOWN},? (?:n\.? ?º? ?)?\d+\w?(?:, ?\d+º ?\w?)?, (?:[A-Z]-)?\d{{4,5}}(?:-\d{{3}})? {_TOWN}{_END}",
    r"(?:\p{Han}{2,8}?(?:省|自治区))?\p{Han}{2,6}?市\p{Han}{1,8}?[区县镇]\p{Han}{1,12}?[路街道巷弄]\d+号?(?:\d+[号楼栋幢座])?(?:\d+单元)?(?:\d+[室层楼])?",
]
_ADDRESS = regex.compile("|".join(f"(?:{p})" for p in _ADDRESSES))
# Forms of address and words that stand before a name or a heading, and are not of it.
_LEAD = r"(?i:mr|mrs|ms|miss|mx|dr|prof|sir|dear|herr|frau|señora?|sra?|mme|monsieur|madame|customer|client|user|contact|person|name|the|a|an|hello|hi|from|to|by|for|with|and|page|title|room|order|ticket|invoice|server|build|tracking|code)"
_NAMES = [
    rf"(?<![\p{{L}}\d.@_/-])(?!{_LEAD}\.?[ ]){_PARTICLE}*{_WORD}, {_WORD}(?: \p{{Lu}}\.(?= ?[^\p{{L}} ]|$))?(?![\p{{Latin}}\d@_-])",
    rf"(?<![\p{{L}}\d.@_/-])(?!{_LEAD}\.?[ ]){_WORD}(?: \p{{Lu}}\.)*(?: {_PARTICLE}*{_WORD}){{1,3}}(?![\p{{Latin}}\d@_-])",
]
_NAME = [regex.compile(p) for p in _NAMES]
# Shapes of numbers, 0 for a digit and A for a letter.
_PHONE_SHAPES = regex.compile(r"\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}|\(?0\d{1,4}\)?[ /-]\d{3,8}(?:-\d{1,5})?|0\d(?: \d\d){4}|0\d{3} \d{3} \d{3,4}|0\d{4} \d{6}|\(?[2-9]\d\d\)?[ .-]\d{3}[.-]\d{4}|1[3-9]\d{9}|1[3-9]\d[ -]\d{4}[ -]\d{4}|0\d{9,10}")
_ID_SHAPES = regex.compile(r"\d{3}-\d{2}-\d{4}|\d{3} \d{3} \d{3}|\d{17}[\dXx]|\d{8}-?[A-Z]|[XYZ]\d{7}[A-Z]|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3}(?: ?\d\d)?|\d{15}")
# Words that stand before a value.
_CUES = {
    "phone": regex.compile(r"(?i)(?:phone|tel|telefon|téléphone|teléfono|mobile|cell|fax|call|dial|ring|number|whatsapp|电话|手机|热线|拨打)\W*$"),
    "id_number": regex.compile(r"(?i)(?:\bids?|identity|insurance no|ssn|national id|tax (?:record|id|no)|passport|personal no|dni|nie|nino|证件号码?|身份证号?码?)\W*$"),
    "name": regex.compile(r"(?i)(?:name|person|customer|client|contact|user|belongs? to|dear(?: \w+\.)?|mr\.?|mrs\.?|ms\.?|dr\.?|herr|frau|联系人是?|姓名|客户|by|from)\W*$"),
    "address": regex.compile(r"(?i)(?:address|ship(?:ped)?(?: it)? to|deliver(?:ed)?(?: it)? to|lives? at|sen[dt](?: it)? to|地址|寄到|送到)\W*$"),
    "email": regex.compile(r"(?i)(?:e-?mail|mailto|write to|contact|邮箱是?)\W*$"),
}
_AFTER_NAME = regex.compile(r"^(?:</li>|\s*[|;]|\s*,? (?:wrote|said|asked|will|has|is|was)\b)")
_OTHER_NUMBER = regex.compile(r"(?i)(?:order(?: no)?|invoice|ticket|tracking(?: code)?|sku|server|build|version|coordinates|room|page|item|article|code|ref|rows?|工单编号|版本是?|编号|共)\W*$")
# Labels of forms and of common pages, weekdays, months and compass points, which are capitalised but no names.
_PLAIN_WORDS = "national id insurance tax record billing delivery address contact phone mail email status form login full assigned signed end table page order ticket guide manual notes release start terms conditions privacy policy home search settings help about news menu cart checkout account support team monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december north south east west".split()
_DIGITS = regex.compile(r"\d")
_LEFT = regex.compile(r"\w+|[^\w\s]")


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, int, int], list[str]]]:
    """(kind, start, end, votes, features) of the spans that may be personal. A vote is 1 for, 2 against, 0 none: by shape, by form, and by context; the first two of names, which need the gazetteer, are given later."""
    out = []

    def add(kind: str, start: int, end: int, shape: int, form: int, context: int, extra: list[str]) -> None:
        before = _LEFT.findall(regex.sub(r"\d+", "0", text[max(0, start - 24) : start]))[-2:]
        names = [f"L={' '.join(before)}", f"l={before[-1] if before else '^'}", f"r={text[end : end + 1]}", f"context={context}", *extra]
        if kind != "name":
            names += [f"shape={shape}", f"form={form}"]
        out.append((kind, start, end, (shape, form, context), [f"{kind}|{n}" for n in names]))

    def cue(kind: str, start: int) -> bool:
        return bool(_CUES[kind].search(text, max(0, start - 28), start))

    for m in _EMAIL.finditer(text) if "@" in text or "＠" in text or "at" in text or "AT" in text or "At" in text else ():
        tail = m.group().rsplit(".", 1)[-1]
        add("email", m.start(), m.end(), 1, 1 if 2 <= len(tail) <= 12 else 2, 1 if cue("email", m.start()) else 0, [f"tld={tail.lower()}"])
    digits = len(_DIGITS.findall(text))
    for m in _ADDRESS.finditer(text) if digits else ():
        add("address", m.start(), m.end(), 1, 1 if regex.search(r"\d", m.group()) else 2, 1 if cue("address", m.start()) else 0, [])
    for m in _NUMBER.finditer(text) if digits >= 6 else ():
        value, start, end = m.group(), m.start(), m.end()
        digits = sum(c.isdigit() for c in value)
        if digits < 6:
            continue
        shaped = regex.sub("[A-Z]", "A", regex.sub(r"\d", "0", value))
        other = bool(_OTHER_NUMBER.search(text, max(0, start - 20), start))
        for kind, shapes, most in (("phone", _PHONE_SHAPES, 15), ("id_number", _ID_SHAPES, 18)):
            context = 1 if cue(kind, start) else 2 if other or cue("id_number" if kind == "phone" else "phone", start) else 0
            shape = 1 if shapes.fullmatch(value) else 2
            if shape == 1 or context == 1:
                form = 1 if 8 <= digits <= most and not (kind == "phone" and regex.search("[A-Z]", value)) else 2
                add(kind, start, end, shape, form, context, [f"of={shaped}", f"n={digits}"])
    for pattern in _NAME if sum(map(str.isupper, text)) > 1 else ():
        for m in pattern.finditer(text):
            start, end = m.span()
            words = regex.findall(r"[\p{L}'’]+", m.group())
            if len(words) < 2 or not (text[start].isupper() or "," in m.group()):
                continue
            low = [w.lower() for w in words]
            context = 1 if cue("name", start) or _AFTER_NAME.search(text[end : end + 12]) else 0
            add("name", start, end, 0, 0, context, [f"comma={',' in m.group()}", f"words={min(len(words), 4)}", *(f"e={w[-4:]}" for w in low), *(f"w={w}" for w in low)])
    return out


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: the probability that a span with such votes is personal. What is expected of a labeler (six times as often right as wrong where it votes) counts PRIOR_SHARE of what is seen of it."""
    rows = list(patterns.items())
    if not rows:
        return {}
    width, weight = len(rows[0][0]), np.array([n for _, n in rows], float)
    votes = np.array([p for p, _ in rows])
    truth = np.clip(0.5 + 0.22 * ((votes == 1).sum(1) - (votes == 2).sum(1)), 0.03, 0.97)
    for _ in range(rounds):
        prior = (weight @ truth + 0.5) / (weight.sum() + 1)
        lead = np.full(len(rows), np.log(prior / (1 - prior)))
        for j in range(width):
            table = []
            for mass, expected in ((weight * (1 - truth), (4, 1, 6)), (weight * truth, (4, 6, 1))):
                seen = np.array([mass[votes[:, j] == v].sum() for v in range(3)])
                seen += PRIOR_SHARE * (seen.sum() + 1) * np.array(expected) / sum(expected)
                table.append(np.log(seen / seen.sum()))
            says = table[1] - table[0]
            # A labeler may be found weak, but its vote never speaks for the opposite.
            lead += np.array([says[0], max(says[1], 0.0), min(says[2], 0.0)])[votes[:, j]]
        truth = 1 / (1 + np.exp(-np.clip(lead, -50, 50)))
    return {p: float(t) for (p, _), t in zip(rows, truth)}


def train_classifier(spans: list[tuple[list[int], float]], epochs: int = 30, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on hashed features, fitted to the aggregated labels; the last is the constant."""
    weights = np.zeros(BUCKETS + 1)
    if not spans:
        return weights
    columns = [np.array([*f, BUCKETS]) for f, _ in spans]
    flat, sizes = np.concatenate(columns), np.array([len(c) for c in columns])
    at, owner, target = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(columns)), sizes), np.array([t for _, t in spans])
    square = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[flat], at), -30, 30)))
        grad = np.bincount(flat, (target - p)[owner], minlength=BUCKETS + 1) / len(columns) - 1e-5 * weights
        square += grad**2
        weights += rate * grad / np.sqrt(square)
    return weights


def resolve(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of overlapping finds the longest stays, then the more probable one."""
    kept: list[tuple[str, int, int]] = []
    for kind, start, end, _ in sorted(found, key=lambda f: (f[1] - f[2], -f[3], f[1], f[0])):
        if all(end <= s or start >= e for _, s, e in kept):
            kept.append((kind, start, end))
    return sorted(kept, key=lambda k: k[1])


def _text_values(parameters: str | None) -> list[str]:
    try:
        root = deepjson.loads(parameters) if parameters else None
    except ValueError:
        return []
    out, stack = [], [root]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("text"), str):
                out.append(v["text"])
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return out


def field_texts(browser: DataFrame) -> DataFrame:
    """(traj_id, step_pos, field, text): thoughts, outputs, and the strings under ``text`` of the parameters."""
    texts = F.udf(_text_values, "array<string>", useArrow=True)
    steps = browser.where("traj_id IS NOT NULL").select(F.col("traj_id").cast("bigint").alias("traj_id"), F.posexplode("steps").alias("step_pos", "s"))
    plain = steps.select("traj_id", F.col("step_pos").cast("bigint").alias("step_pos"), F.explode(F.array(F.struct(F.lit("thought").alias("field"), F.col("s.thought").alias("text")), F.struct(F.lit("output").alias("field"), F.col("s.tool_result.output").alias("text")))).alias("t")).select("traj_id", "step_pos", "t.*")
    typed = steps.where(F.col("s.tool_call.parameters").contains('"text"')).select("traj_id", F.col("step_pos").cast("bigint").alias("step_pos"), F.lit("text").alias("field"), F.explode(texts("s.tool_call.parameters")).alias("text"))
    return plain.unionByName(typed).where(F.length("text") > 0)


#: What any candidate needs: a digit, an at sign (also written out in brackets), or two capitals.
_MAYBE = r"[0-9\p{Nd}@＠]|[(\[{]\s?[aA][tT]|(?s)\p{Lu}.*\p{Lu}"
_SPAN = "kind string, start int, end int, value string, shape int, form int, context int, phrase string, words array<string>, features array<int>"


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SPAN.split(", ")]
    for batch in batches:
        out = []
        for key, times, text in zip(batch["key"], batch["times"], batch["text"]):
            for kind, start, end, (shape, form, context), names in candidates(text):
                words = [w.lower() for w in regex.findall(r"[\p{L}'’]+", text[start:end])] if kind == "name" else None
                out.append((key, times, kind, start, end, text[start:end], shape, form, context, words and " ".join(words), words, hashed(names)))
        yield pd.DataFrame(out, columns=["key", "times", *columns])


def _phrases(names: DataFrame, given_names: DataFrame) -> DataFrame:
    """(phrase, known, like, plain, spread): for every distinct name candidate whether a word of it is a given name or ends like several of them, how many of its words are labels, and how its words combine with others (1 as given names do, 2 not at all).

    A word's mates are the effective number of phrases it stands in, n squared by the sum of the squares of their counts: near 1 where one phrase has it all. The yardstick is the given names themselves: how many mates they have, and how often one phrase with them stands. A word that stands far more often than that and yet has one mate is of a title or a brand, and so is what begins like it.
    """
    given = cut(given_names.where("name IS NOT NULL").select(F.lower(F.trim("name")).alias("word")).where("word <> ''").distinct())
    n_given = given.count()
    tails = lambda w: F.array(*(F.right(w, F.lit(k)) for k in (3, 4, 5)))
    ends = given.select("word", F.explode(tails(F.col("word"))).alias("tail")).where("length(word) > length(tail) + 1").groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, n_given // 100)).select("tail")
    phrases = cut(names.groupBy("phrase").agg(F.sum("times").alias("n"), F.any_value("words").alias("words")))
    single = phrases.select("phrase", "n", F.explode(F.array_distinct("words")).alias("word"))
    n = F.col("n").cast("double")
    words = single.groupBy("word").agg((F.sum(n) * F.sum(n) / F.sum(n * n)).alias("mates"), F.sum("n").alias("often"))
    words = words.join(given.withColumn("known", F.lit(True)), "word", "left")
    like = words.select("word", F.explode(tails(F.col("word"))).alias("tail")).join(ends, "tail", "left_semi").select("word").distinct().withColumn("like", F.lit(True))
    words = words.join(like, "word", "left").select("word", "mates", "often", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("like", F.lit(False)).alias("like"), F.col("word").isin(_PLAIN_WORDS).alias("plain"))
    words = cut(words)
    joined = cut(single.join(words, "word"))
    usual = joined.where("known").agg(F.percentile_approx("mates", 0.5).alias("mates"), F.percentile_approx("n", 0.5).alias("n")).first()
    fixed = (F.col("mates") <= 1.5) & (F.col("often") > 8 * (usual["n"] or 0)) if usual["n"] else F.lit(False)
    combines = F.col("known") | (2 * F.col("mates") >= usual["mates"]) if usual["n"] else F.lit(False)
    judged = joined.groupBy("phrase").agg(F.max("known").alias("known"), F.max("like").alias("like"), F.count_if("plain").alias("plain"), F.max(fixed).alias("fixed"), F.max(combines).alias("combines"))
    spread = F.when(F.col("known"), 1).when(F.col("fixed"), 2).when(F.col("combines"), 1).otherwise(0)
    return judged.select("phrase", "known", "like", F.least("plain", F.lit(2)).alias("plain"), spread.alias("spread"))


def _voted(spans: DataFrame, given_names: DataFrame) -> DataFrame:
    """The spans with all votes and, for names, the features that follow from their phrase."""
    phrases = _phrases(spans.where("kind = 'name'"), given_names)
    bucket = lambda label, c: F.pmod(F.crc32(F.concat(F.lit(f"name|{label}="), c.cast("string")).cast("binary")), F.lit(BUCKETS)).cast("int")
    # One observation is one vote: the model takes votes as independent, so a label's against is not cast twice.
    shape = F.when(F.col("like"), 1).otherwise(0)
    form = F.when(F.col("known"), 1).when(F.col("plain") > 0, 2).otherwise(0)
    named = spans.where("kind = 'name'").join(phrases, "phrase")
    named = named.withColumns({"shape": shape, "form": form})
    named = named.withColumn("features", F.concat("features", F.array(*(bucket(c, F.col(c)) for c in ("shape", "form", "context", "plain", "known", "like", "spread")))))
    both = named.drop("known", "like", "plain").unionByName(spans.where("kind <> 'name'").withColumn("spread", F.lit(0)))
    return both.select("key", "times", "kind", "start", "end", "value", F.array("shape", "form", "context", "spread").alias("votes"), "features")


def _decided(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = np.array([weights[f].sum() for f in batch["features"]]) + weights[BUCKETS]
            yield batch.assign(z=z)[["key", "kind", "start", "end", "value", "z"]][z > 0]

    return run


def _resolved(spans: pd.Series) -> pd.Series:
    def one(found: list) -> list[tuple]:
        values = {(f["kind"], f["start"], f["end"]): f["value"] for f in found}
        return [(*span, values[span]) for span in resolve([(f["kind"], f["start"], f["end"], f["z"]) for f in found])]

    return spans.map(one)


def personal_spans(browser: DataFrame, given_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, texts, finds): (traj_id, step_pos, field, key) of all texts, (key, text) of the distinct ones, and (key, found) with an array of (kind, start, end, value) for those that hold personal values.

    The texts are searched once; what is counted, learned and decided afterwards works on the candidates alone.
    """
    key = F.unhex(F.md5("text"))
    values = field_texts(browser)
    places = cut(values.select("traj_id", "step_pos", "field", key.alias("key")).distinct())
    # Grouped and joined by the key, the texts move once.
    texts = values.select("text", key.alias("key")).groupBy("key").agg(F.any_value("text").alias("text"))
    weighed = texts.where(F.col("text").rlike(_MAYBE)).join(places.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "key")
    spans = cut(weighed.select("key", "times", "text").mapInPandas(_searched, f"key binary, times bigint, {_SPAN}"))
    spans = cut(_voted(spans, given_names))
    counted: dict[str, dict[tuple[int, ...], int]] = {k: {} for k in KINDS}
    for r in spans.groupBy("kind", "votes").agg(F.sum("times").alias("n")).collect():  # at most 3 ** 4 patterns a kind
        counted[r["kind"]][tuple(r["votes"])] = r["n"]
    truth = {kind: reliabilities(patterns) for kind, patterns in counted.items()}
    first = Window.partitionBy("kind").orderBy(F.xxhash64("features"), "features")
    picked = spans.select("kind", "votes", "features").distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= TRAINING_SPANS).collect()
    picked.sort(key=lambda r: (r["kind"], r["rn"]))
    weights = train_classifier([(r["features"], truth[r["kind"]][tuple(r["votes"])]) for r in picked])
    decided = spans.mapInPandas(_decided(weights), "key binary, kind string, start int, end int, value string, z double")
    listed = decided.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "z", "value")).alias("spans"))
    resolved = F.pandas_udf(_resolved, "array<struct<kind:string,start:int,end:int,value:string>>")
    return places, texts, listed.select("key", resolved("spans").alias("found"))


def personal_values(browser: DataFrame, given_names: DataFrame) -> DataFrame:
    """(traj_id, step_pos, field, kind, value): every personal value of thoughts, outputs and typed texts, exactly as it stands.

    Labelers by shape, form and gazetteer, context, and, for names, by how words combine over all rows vote on each candidate; expectation-maximisation over all candidates estimates how far each can be trusted; its labels train a logistic span classifier, which decides; of overlapping finds the longest stays. Null and empty texts and null ids give no row; a value that stands several times in one field gives one row; rows stored twice give theirs once and copied texts are searched once; an empty table or gazetteer gives no error, and a gazetteer of any size is joined, not collected; other columns are not read. Texts are read whole.
    """
    places, _, finds = personal_spans(browser, given_names)
    values = finds.select("key", F.explode("found").alias("f")).select("key", "f.kind", "f.value").distinct()
    return places.join(values, "key").select("traj_id", "step_pos", "field", "kind", "value")


def _redacted(text: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for t, spans in zip(text, found):
        parts, at = [], 0
        for f in spans if spans is not None else ():
            parts += [t[at : f["start"]], f"[{f['kind'].upper()}]"]
            at = f["end"]
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out)


def redacted_texts(browser: DataFrame, given_names: DataFrame) -> DataFrame:
    """(traj_id, step_pos, field, text): the same texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME] in place of the values; else as in ``personal_values``."""
    places, texts, finds = personal_spans(browser, given_names)
    redacted = F.pandas_udf(_redacted, "string")
    whole = texts.join(finds, "key", "left").select("key", F.when(F.col("found").isNull(), F.col("text")).otherwise(redacted("text", "found")).alias("text"))
    return places.join(whole, "key").select("traj_id", "step_pos", "field", "text").distinct()
