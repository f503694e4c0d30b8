"""Text cut off by field limits or mid-transfer, found by how often word trigrams end a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import parse_document
from stepweave.runtime import cut

#: A trigram seen less often says nothing by itself; its shorter contexts are asked.
SEEN = 5
#: Share of ends below which a trigram without a full stop is almost never terminal.
RARELY = 0.2
#: The same for a trigram that closes with a full stop, as of "no." or "48." in a longer number.
HARDLY = 0.01
#: Share of the ends after the same two tokens below which a trigram that only ends texts is itself a piece.
SELDOM = 0.02
#: Letters up to which the beginnings of longer words are listed; beyond, words meet by their first PREFIX letters.
PREFIX = 48
#: A length is a limit of a field where CROWD times as many endings of ENDING characters stand as around it, within NEAR on both sides.
CROWD, NEAR, ENDING = 4, 5, 16
#: Tokens of a text up to which, without any evidence, a missing full stop is the writer's.
SHORT = 4

_TOKEN = r"(\p{IsHan}|[\p{L}\p{M}]+(?:_[\p{L}\p{M}]+)+|[\p{L}\p{M}]+|0|[^\s\p{L}\p{M}0])"
# Words that stand in brackets where a text was cut.
_MARK = r"(?i)(?:(?<!\.)\.{3,}|…)?\s{0,4}[\[(<](?:truncated|cut|cut off|more|continued|cont\.?|snip|clipped|output truncated|read more|截断|已截断|省略|更多)[^\[\]()<>]{0,24}[\])>]\s*$"
_PATTERNS = {
    "token": _TOKEN,
    "digits": r"\p{Nd}+",
    "some": r"\S",
    "mark": _MARK,
    "dots": r"((?<!\.)\.{3,}|…)\s*$",
    "broken": r"�\s*$",
    "json": r'^\s*(\{|\[\s*[\{\["])',
    "letter": r"^[\p{L}\p{M}]",
    "stop": r"^[.。!?！？>)）\]}|»”\"]$",
}

_FEATURES = """
SELECT key, times, text, marked, broken, json_like, try_element_at(dots, -1) AS dotted, dots, named, lines, n_lines
FROM (
  SELECT *, transform(raw, l -> l rlike :dots) AS dots,
    transform(raw, l -> concat(array('^', '^'), regexp_extract_all(regexp_replace(regexp_replace(l, :dots, ''), :digits, '0'), :token, 1))) AS named,
    transform(named, w -> transform(w, t -> CASE WHEN contains(t, '_') THEN 'N_' ELSE t END)) AS lines
  FROM (
    SELECT key, times, text, marked, broken, json_like, CASE WHEN :whole THEN all_lines ELSE slice(all_lines, -1, 1) END AS raw, size(all_lines) AS n_lines
    FROM (
      SELECT *, filter(split(regexp_replace(text, :mark, ''), '\\n'), l -> l rlike :some) AS all_lines, text rlike :mark AS marked, text rlike :broken AS broken, text rlike :json AS json_like
      FROM {texts})
    )
  )
"""

# A line's end counts as an end, as the lines of lists and steps are whole by themselves. What stands before a replacement character is torn off there, and neither goes on nor ends. Identifiers are counted by name too, as a cut can leave a piece of one.
_COUNTS = """
SELECT t.a, t.b, t.c, t.name, sum(CASE WHEN NOT t.last AND NOT t.torn THEN times ELSE 0 END) AS inside, sum(CASE WHEN t.last THEN times ELSE 0 END) AS ends, sum(CASE WHEN t.last AND t.dotted THEN times ELSE 0 END) AS dots
FROM (
  SELECT times, explode(flatten(transform(lines, (w, l) -> CASE WHEN size(w) > 2 THEN transform(sequence(2, size(w) - 1), i -> named_struct('a', w[i - 2], 'b', w[i - 1], 'c', w[i], 'name', CASE WHEN w[i] = 'N_' THEN named[l][i] END, 'last', i = size(w) - 1, 'torn', coalesce(try_element_at(w, i + 2) = '�', false), 'dotted', dots[l])) ELSE array() END))) AS t
  FROM {feat} WHERE NOT json_like)
GROUP BY t.a, t.b, t.c, t.name
"""

_FINALS = """
SELECT key, marked OR broken AS marked, coalesce(dotted, false) AS dotted, json_like, n_lines > 1 OR coalesce(size(get(lines, 0)) - 2 > {short}, false) AS long,
  CASE WHEN NOT json_like THEN try_element_at(get(lines, 0), -3) END AS a, CASE WHEN NOT json_like THEN try_element_at(get(lines, 0), -2) END AS b,
  CASE WHEN NOT json_like THEN try_element_at(get(lines, 0), -1) END AS c, CASE WHEN json_like THEN text END AS text
FROM {feat}
"""

# For every distinct last trigram: its own counts, those of its last two tokens, and whether it goes on to longer words that are frequent here and together more frequent than its ends. Judged by shares, so that a larger table of the same texts gives the same. Longer words meet their beginnings by equality: each gives its prefixes below PREFIX letters, and longer beginnings are found by their first PREFIX letters.
_ENDS = f"""
WITH ends AS (SELECT DISTINCT a, b, c FROM {{finals}}),
words AS (SELECT a, b, coalesce(name, c) AS c, inside + ends AS n FROM {{named}} WHERE inside >= {SEEN} AND length(c) > 1),
pairs AS (SELECT b, c, sum(inside) AS inside2, sum(ends) AS ends2 FROM {{counts}} GROUP BY b, c HAVING sum(inside) + sum(ends) >= {SEEN}),
contexts AS (SELECT a, b, sum(ends) AS ends_here FROM {{counts}} GROUP BY a, b),
prefixes AS (SELECT a, b, left(c, l) AS c, sum(n) AS longer FROM (SELECT *, explode(sequence(1, least(length(c), {PREFIX}) - 1)) AS l FROM words) GROUP BY a, b, left(c, l)),
pair_prefixes AS (SELECT DISTINCT b, left(c, l) AS c FROM (SELECT *, explode(sequence(1, least(length(c), {PREFIX}) - 1)) AS l FROM pairs WHERE inside2 >= {SEEN} AND length(c) > 1)),
longer AS (
  SELECT e.a, e.b, e.c, p.longer FROM ends e JOIN prefixes p ON e.a = p.a AND e.b = p.b AND e.c = p.c WHERE e.c rlike :letter
  UNION ALL
  SELECT e.a, e.b, e.c, sum(w.n) FROM (SELECT * FROM ends WHERE length(c) >= {PREFIX} AND c rlike :letter) e
  JOIN (SELECT * FROM words WHERE length(c) > {PREFIX}) w ON e.a = w.a AND e.b = w.b AND left(e.c, {PREFIX}) = left(w.c, {PREFIX}) AND length(w.c) > length(e.c) AND startswith(w.c, e.c)
  GROUP BY e.a, e.b, e.c),
longer_pairs AS (
  SELECT e.a, e.b, e.c FROM ends e LEFT SEMI JOIN pair_prefixes p ON e.b = p.b AND e.c = p.c WHERE e.c rlike :letter
  UNION ALL
  SELECT e.a, e.b, e.c FROM (SELECT * FROM ends WHERE length(c) >= {PREFIX} AND c rlike :letter) e
  LEFT SEMI JOIN (SELECT * FROM pairs WHERE inside2 >= {SEEN} AND length(c) > {PREFIX}) w ON e.b = w.b AND left(e.c, {PREFIX}) = left(w.c, {PREFIX}) AND length(w.c) > length(e.c) AND startswith(w.c, e.c))
SELECT e.a, e.b, e.c, coalesce(t.inside, 0) AS inside, coalesce(t.ends, 0) AS ends, coalesce(t.dots, 0) AS dots, p.inside2, p.ends2, coalesce(x.ends_here, 0) AS ends_here,
  coalesce(l.longer, 0) AS longer, coalesce(t.ends, 0) < coalesce(l.longer, 0) AS part_of_word, lp.c IS NOT NULL AS part_of_pair
FROM ends e
LEFT JOIN {{counts}} t ON e.a = t.a AND e.b = t.b AND e.c = t.c
LEFT JOIN contexts x ON e.a = x.a AND e.b = x.b
LEFT JOIN pairs p ON e.b = p.b AND e.c = p.c
LEFT JOIN longer l ON e.a = l.a AND e.b = l.b AND e.c = l.c
LEFT JOIN longer_pairs lp ON e.a = lp.a AND e.b = lp.b AND e.c = lp.c
"""

# Four verdicts for each distinct trigram: with and without dots behind it, in a short and in a longer text.
_CUT = f"""
SELECT a, b, c, stop, form.dotted, form.long,
  CASE
    WHEN form.dotted AND part_of_word THEN true
    WHEN form.dotted AND dots >= {SEEN} AND dots > 0.5 * (inside + ends) THEN false
    WHEN form.dotted THEN form.long OR inside >= {SEEN}
    WHEN stop AND inside + ends >= {SEEN} THEN ends < {HARDLY} * (inside + ends)
    WHEN stop THEN coalesce(inside2 + ends2 >= 10 * {SEEN} AND ends2 < {HARDLY} * (inside2 + ends2), false)
    WHEN part_of_word THEN inside < {RARELY} * (inside + ends) OR ends < {RARELY} * (inside + ends) OR ends < {HARDLY} * longer
    WHEN inside + ends >= {SEEN} AND inside > 0 THEN ends < {RARELY} * (inside + ends)
    WHEN inside + ends >= {SEEN} THEN ends < {SELDOM} * ends_here
    WHEN inside2 + ends2 >= {SEEN} THEN ends2 < {RARELY} * (inside2 + ends2)
    WHEN part_of_pair THEN true
    ELSE form.long
  END AS cut
FROM (SELECT *, c rlike :stop AS stop, explode(array(named_struct('dotted', true, 'long', true), named_struct('dotted', true, 'long', false), named_struct('dotted', false, 'long', true), named_struct('dotted', false, 'long', false))) AS form FROM {{ends}})
"""


def texts_of(browser: DataFrame) -> DataFrame:
    """(traj_id, step_pos, field, agent, text) of the thoughts and outputs that aren't null or blank."""
    return browser.sparkSession.sql(
        """SELECT traj_id, step_pos, agent, field, text
        FROM (SELECT traj_id, agent, posexplode(steps) AS (step_pos, s) FROM {b} WHERE traj_id IS NOT NULL)
        LATERAL VIEW stack(2, 'thought', s.thought, 'output', s.tool_result.output) t AS field, text
        WHERE text rlike '\\\\S'""",
        args={"some": r"\S"},
        b=browser.select("traj_id", "agent", "steps"),
    )


def judged_ends(values: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, ``cut`` and ``stop`` (whether a mark that closes a text stands last) for every distinct row of ``carry`` whose ``text`` isn't null; see ``cut_values``.

    Every distinct text is read once and weighs as many times as different rows hold it, so that copies cost no more and rows stored twice weigh no more.
    """
    spark = values.sparkSession
    key = F.unhex(F.md5("text"))
    held = values.where("text IS NOT NULL").select(*carry, "text", key.alias("key"))
    rows = cut(held.select(*carry, "key").distinct())
    # Grouped and joined by the key, the texts move once.
    texts = cut(held.groupBy("key").agg(F.any_value("text").alias("text")).join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "key"))
    # Two readings of the texts: one for the counts, which are a vocabulary, one for the last tokens of the last line.
    named = cut(spark.sql(_COUNTS, feat=spark.sql(_FEATURES, args=_PATTERNS | {"whole": True}, texts=texts)))
    counts = spark.sql("SELECT a, b, c, sum(inside) AS inside, sum(ends) AS ends, sum(dots) AS dots FROM {named} GROUP BY a, b, c", named=named)
    finals = spark.sql(_FINALS, feat=spark.sql(_FEATURES, args=_PATTERNS | {"whole": False}, texts=texts), short=SHORT)
    open_json = F.coalesce(F.col("json_like") & parse_document(F.col("text")).isNull(), F.lit(False))
    finals = cut(finals.withColumn("open_json", open_json).drop("text"))
    known = finals.where("c IS NOT NULL AND a IS NOT NULL")
    ends = spark.sql(_ENDS, args=_PATTERNS, finals=known, counts=counts, named=named)
    judged = spark.sql(
        """SELECT f.key, CASE WHEN f.json_like THEN f.open_json ELSE f.marked OR coalesce(j.cut, false) END AS cut, f.json_like OR coalesce(j.stop, false) AS stop
        FROM {finals} f LEFT JOIN {judged} j ON f.a = j.a AND f.b = j.b AND f.c = j.c AND f.dotted = j.dotted AND f.long = j.long""",
        finals=finals,
        judged=spark.sql(_CUT, args=_PATTERNS, ends=ends),
    )
    return rows.join(judged, "key").select(*carry, "cut", "stop")


def field_limits(browser: DataFrame) -> DataFrame:
    """(agent, field, unit, size, n, expected): lengths in characters or UTF-8 bytes at which the values of a source pile up, as behind a limit of the field.

    A length is a limit when more than CROWD times as many different endings (ENDING characters, digits alike) have it as its neighbours within NEAR on either side have on average, plus one: a set phrase has one ending, however often it stands.
    """
    return browser.sparkSession.sql(
        f"""WITH sizes AS (
          SELECT agent, field, unit, size, count(*) AS n FROM (
            SELECT DISTINCT agent, field, unit, size, ending FROM (SELECT agent, field, length(text) AS chars, octet_length(text) AS bytes, regexp_replace(right(text, {ENDING}), '[0-9]', '0') AS ending FROM {{v}})
            LATERAL VIEW stack(2, 'characters', chars, 'bytes', bytes) t AS unit, size)
          GROUP BY agent, field, unit, size),
        near AS (SELECT *, sum(n) OVER (PARTITION BY agent, field, unit ORDER BY size RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) - n AS others FROM sizes)
        SELECT agent, field, unit, size, n, round(others / {2 * NEAR}, 2) AS expected FROM near WHERE n > {CROWD} * (others / {2 * NEAR} + 1)""",
        v=texts_of(browser),
    )


def judged_values(browser: DataFrame) -> DataFrame:
    """(traj_id, step_pos, field, agent, cut) for every thought and output: by its end, and, where it has no closing mark, also by standing at a limit of its source."""
    values = texts_of(browser).withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text"))
    judged = judged_ends(values, ["traj_id", "step_pos", "field", "agent", "chars", "bytes"])
    return _with_limits(judged, cut(field_limits(browser)))


def _with_limits(judged: DataFrame, limits: DataFrame) -> DataFrame:
    return judged.sparkSession.sql(
        """SELECT j.traj_id, j.step_pos, j.field, j.agent, j.cut OR (NOT j.stop AND (c.size IS NOT NULL OR b.size IS NOT NULL)) AS cut FROM {j} j
        LEFT JOIN (SELECT * FROM {limits} WHERE unit = 'characters') c ON c.agent <=> j.agent AND c.field = j.field AND c.size = j.chars
        LEFT JOIN (SELECT * FROM {limits} WHERE unit = 'bytes') b ON b.agent <=> j.agent AND b.field = j.field AND b.size = j.bytes""",
        j=judged,
        limits=limits,
    )


def cut_values(browser: DataFrame) -> DataFrame:
    """(traj_id BIGINT, step_pos BIGINT, field): the thoughts and outputs whose end is missing.

    Word trigrams (numbers and identifiers made alike, Han text by character) are counted inside all texts and at their ends. A text is cut when its last trigram is frequent inside but almost never ends a text; when its last word goes on, in the same context, to longer ones that are more frequent than its ends, whatever their number; when a mark of cutting stands behind it; when dots stand behind a trigram after which nobody else writes dots; when it is JSON that doesn't close; or when it has no closing mark and is exactly as long as a limit at which the values of its agent and field pile up. Rare trigrams ask their last two words, and then the full stop.

    Null and blank values are not cut; steps and trajectories stored twice give one row; an empty table gives no row; columns beyond traj_id, agent and steps are not read. Very long texts are counted whole.
    """
    return judged_values(browser).where("cut").selectExpr("CAST(traj_id AS BIGINT) AS traj_id", "CAST(step_pos AS BIGINT) AS step_pos", "field").distinct()


def cut_shares(browser: DataFrame) -> DataFrame:
    """(agent, field, n_values, n_cut, share): how often each source cuts; the null agent is one source."""
    one = judged_values(browser).groupBy("traj_id", "step_pos", "field", "agent").agg({"cut": "max"}).withColumnRenamed("max(cut)", "cut")
    return one.sparkSession.sql("SELECT agent, field, count(*) AS n_values, count_if(cut) AS n_cut, round(count_if(cut) / count(*), 6) AS share FROM {one} GROUP BY agent, field", one=one)
