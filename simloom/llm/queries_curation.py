"""Registered queries of phrase mining, conversation repair and the cascade of quality rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import cascade, collocations, repair
from simloom.llm.registry import query, table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_collocations", sql=rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS sizes(k)
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
longer AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3
), most AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL),
kept AS (
  SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE NOT (k = 2 AND coalesce(100 * most >= 50 * a, false))
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lw, array_to_string(w[cut + 1:], ' ') AS rw
  FROM kept, (VALUES (1), (2)) AS places(cut) WHERE cut < k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lw JOIN f y ON y.lang = c.lang AND y.phrase = c.rw
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), longest=3, least=10, first=2000, share=50)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32(`conv_id:turn`) % 20; ``lost`` marks those that are dropped. NULLs are one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("lost"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _edit_rows() -> str:
    """The edits around one turn as SQL values: place, letters, place after, cost, inserted text, what is done, role needed or given."""
    rows = []
    for place in range(4):
        for block in repair.BLOCKS:
            there, roles = repair._inserted(place, len(block) - 1)
            cost = repair.INSERT * len(roles) + {"D": repair.DELETE, "R": repair.REROLE, "K": 0}[block[-1]]
            ins = "".join(f"~{repair._ROLES[r]}:" for r in roles)
            if block[-1] == "D":
                rows.append((place, block, there, cost, ins, "D", ""))
            elif block[-1] == "R":
                missing = repair._MISSING[there]
                rows.append((place, block, missing + 1, cost, ins, "R", repair._ROLES[missing]))
            else:
                for role, letter in enumerate(repair.INITIALS):
                    to = repair._after(there, role)
                    if to is not None:
                        rows.append((place, block, to, cost, ins, "K", letter))
    return ", ".join(f"({a}, '{b}', {c}, {d}, '{e}', '{f}', '{g}')" for a, b, c, d, e, f, g in rows)


@query("op12_conversation_repair", sql=rf"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, xor(v >> 1, 3988292384 * (v & 1)), step + 1 FROM bits WHERE step < 8
), crc AS (SELECT list(v ORDER BY b) AS table_ FROM bits WHERE step = 8
), damage AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, x: xor(a >> 8, table_[(xor(a, x) & 255) + 1]))) % 20 AS m
  FROM conversations, crc
), t AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN m = 1 THEN '' WHEN m = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM damage WHERE m <> 0
), ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), o AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS letter
  FROM t JOIN ids ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
), r AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         coalesce(lag(letter) OVER (PARTITION BY c ORDER BY i) || letter NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM o
), edits(q, block, q2, cost, ins, op, who) AS (VALUES {_edit_rows()}
), dp AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'rep': ''}} AS best FROM ids
  UNION ALL
  SELECT c, i, q, min(best) FROM (
    SELECT d.c, r.i, e.q2 AS q, {{'cost': d.best.cost + e.cost + CASE WHEN op <> 'D' AND fault = 3 THEN 3 ELSE 0 END,
      'audit': d.best.audit || block,
      'rep': d.best.rep || replace(ins, '~', chr(10)) || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || who || ':' || text END}} AS best
    FROM dp d JOIN r ON r.c = d.c AND r.i = d.i + 1
    JOIN edits e ON e.q = d.q AND (op = 'D' OR (fault NOT IN (1, 2) AND (op = 'R' OR who = letter)))
  ) GROUP BY c, i, q
), facts AS (
  SELECT c, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM r GROUP BY c
), done AS (
  SELECT dp.c, min({{'cost': best.cost + 3 * len(tail), 'audit': best.audit || repeat('I', len(tail)),
    'rep': best.rep || array_to_string(list_transform(tail, lambda x: chr(10) || x || ':'), '')}}) AS best
  FROM dp LEFT JOIN facts USING (c) JOIN (VALUES (0, []::VARCHAR[]), (1, ['user', 'assistant']), (2, ['assistant']), (3, []::VARCHAR[])) AS ends(q, tail) ON ends.q = dp.q
  WHERE dp.i = coalesce(rows_, 0) GROUP BY dp.c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(substr(best.rep, 2)) AS repaired_sha256
FROM ids JOIN done USING (c) LEFT JOIN facts USING (c)
""")
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.audit(damaged(table(spark, sf, "conversations")), lost="lost")


@query("op13_quality_rules", sql=r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM d
), again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, win) > 1),
repeats AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) AS n_lower,
         length(t) - length(translate(t, '!', '')) AS n_shouts, length(t) - length(translate(t, '0123456789', '')) AS n_digits,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
  FROM d LEFT JOIN repeats USING (id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 60 * (n_upper + n_lower) OR 10 * n_shouts > 3 * n_words
            OR 100 * n_digits > 60 * word_chars OR 100 * n_cut_lines > 50 * n_lines OR longest_word > 1000) AS kept
FROM m
""")
def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = cascade.screen(table(spark, sf, "documents"), report=counts)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc.doc_id", *[f"measure.{c}" for c in counts], "kept").withColumn("base_failed", failed)
