"""Queries over texts that look like an agreed phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm.lookalikes import _FROM, _MANY, _TO, consistent_forms, find_lookalikes


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue, phrase = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("cue", "phrase"))
    return find_lookalikes(cue, phrase, ["file_id", "seq"]).select("file_id", "seq", "phrase_id").distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_forms(spark.read.parquet(f"{sf_dir}/cue.parquet"))


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}



def _shape(x: str) -> str:
    """The shape of a text, composed: what is equal under the collation is equal here."""
    text = f"translate(regexp_replace(regexp_replace({x}, '[\\p{{Z}}\\t-\\r\\x{{85}}]+', ' ', 'g'), '[\\p{{Cf}}\\p{{Cc}}\\x{{34f}}\\x{{115f}}\\x{{1160}}\\x{{3164}}\\x{{ffa0}}\\x{{fe00}}-\\x{{fe0f}}]+', '', 'g'), @from, @to)"
    for c, to in _MANY.items():
        text = f"replace({text}, '{c}', '{to.replace(chr(39), chr(39) * 2)}')"
    text = text.replace("@from", "'" + _FROM.replace("'", "''") + "'").replace("@to", "'" + _TO.replace("'", "''") + "'")
    return f"nfc_normalize(trim(regexp_replace(CASE WHEN regexp_matches({x}, '[^ -~]') THEN {text} ELSE {x} END, ' +', ' ', 'g')))"


ORACLES = {
    "p3_found": f"""WITH c AS (SELECT DISTINCT file_id, seq, content, {_shape('content')} AS k FROM cue WHERE content <> ''),
      p AS (SELECT phrase_id, phrase, {_shape('phrase')} AS k FROM phrase WHERE phrase <> '')
      SELECT DISTINCT file_id, seq, phrase_id FROM c JOIN p USING (k) WHERE content <> phrase AND k <> ''""",
    "p3_forms": f"""WITH t AS (SELECT content, count(*) AS n_rows FROM cue WHERE content <> '' GROUP BY content),
      k AS (SELECT content, n_rows, {_shape('content')} AS k FROM t),
      b AS (SELECT k, arg_min(content, struct_pack(n := -n_rows, c := content)) AS canonical FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1)
      SELECT content, canonical, n_rows FROM k JOIN b USING (k)""",
}
