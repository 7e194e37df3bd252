"""Chat formatting: link tool calls with their results, order them, validate arguments, write canonical JSON.

DataFrame functions only. Argument values are JSON texts (`3`, `"a"`, `true`), so that their kind can be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

_PLAIN = r'[^"\\\x00-\x1F]*+'
_STRING = rf'"{_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}){_PLAIN})*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
#: What the canonical form of a JSON value of each kind looks like.
KINDS = {"integer": r"^-?(0|[1-9][0-9]*)(e[0-9]+)?\z", "number": r"^-?[0-9]", "boolean": r"^(true|false)\z", "null": r"^null\z", "string": '^"', "array": r"^\[", "object": r"^\{"}
_KEY = ("conv_id", "call_id")
#: A surrogate that has no partner, as an escape.
_LONE = r"\\u([dD][89abAB][0-9a-fA-F]{2})(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})"


def quoted(text: Column) -> Column:
    """A JSON string; null becomes the text null."""
    inside = F.to_json(F.array(text))
    return F.coalesce(F.when(text.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2)), F.lit("null"))


def number(text: Column) -> Column:
    """One form per number, with all its digits: plain with up to 20 places before or after them, else with an exponent."""
    whole, part = F.regexp_extract(text, "^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(text, "[eE]([-+]?[0-9]+)$", 1), F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    led = F.regexp_replace(F.concat(whole, part), "^0+", "")
    digits = F.regexp_replace(led, "0+$", "")
    by = power - F.length(part) + (F.length(led) - F.length(digits))
    small = F.least(F.greatest(by, F.lit(-99)), F.lit(99)).cast("int")
    point = F.length(digits) + small
    below = F.when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -point)), digits))
    body = F.when(by.between(0, 20), F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), small)))).when(by.between(-20, -1), below).otherwise(F.concat(digits, F.lit("e"), by.cast("string")))
    return F.when(digits == "", "0").otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), body))


def _held(text: Column) -> Column:
    """A JSON text in which what a variant would change stands as strings: numbers after \u0001n, surrogates without a
    partner after \u0001l; a \u0001 of the text itself becomes \u0001u. White space between values goes."""
    token = F.regexp_extract_all(text, F.lit(f"(?s){_STRING}|{_NUMBER}|[^\"0-9-]+|."), F.lit(0))
    kept = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)\\u0001", r"$1\\u0001u"), r"(?<!\\)((?:\\\\)*)(?:" + _LONE + ")", r"$1\\u0001l$2$3")
    one = lambda t: F.when(F.startswith(t, F.lit('"')), F.when(F.contains(t, F.lit("\\u")), kept(t)).otherwise(t)).when(t.rlike("^-?[0-9]"), F.concat(F.lit('"\\u0001n'), number(t), F.lit('"'))).otherwise(F.regexp_replace(t, r"[ \t\n\r]+", ""))
    return F.array_join(F.transform(token, one), "")


def parsed(text: Column) -> Column:
    """A JSON value in canonical form; NULL if the text isn't one value and nothing else, which a parser that stops
    after the first value doesn't tell, but the value within an array does."""
    held = _held(text)
    alone, listed = F.to_json(F.try_parse_json(held)), F.to_json(F.try_parse_json(F.concat(F.lit("["), held, F.lit("]"))))
    again = F.when(listed == F.concat(F.lit("["), alone, F.lit("]")), alone)
    for old, new in ((r'"\\u0001n([^"]*)"', "$1"), (r"\\u0001l([0-9a-fA-F]{4})", r"\\u$1"), (r"\\u0001u", r"\\u0001")):
        again = F.regexp_replace(again, old, new)
    return again


def value_of(text: Column) -> Column:
    """A JSON value written again from what it holds: strings with the escapes that they need (a surrogate without a
    partner stays one), the keys of objects in order of UTF-16, one form per number and no white space. NULL is the
    text null; a text that isn't JSON, or holds an object with a key twice, becomes a string."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+\z", "")
    string = F.get_json_object(F.concat(F.lit('{"v":'), trimmed, F.lit("}")), "$.v")
    plain = trimmed.rlike(rf"^{_STRING}\z") & ~trimmed.rlike(r"\\u([dD][89a-fA-F]|0001)")
    return F.when(text.isNull(), "null").when(plain, quoted(string)).otherwise(F.coalesce(parsed(trimmed), quoted(text)))


def canonical(values: Column) -> Column:
    """A JSON object of a map from names to JSON values: names in order of UTF-16, no white space."""
    pairs = F.array_sort(F.transform(F.map_entries(values), lambda p: F.struct(F.encode(p["key"], "UTF-16BE").alias("order"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def _same(a: str, b: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def levels(calls: DataFrame) -> DataFrame:
    """row, level of calls (conv_id, call_id, row, first) with `after`, the ids of calls that must come first.

    An id means the call of that id where `first` holds; null ids are no one's. Level 0 has no known predecessor;
    others come one after their latest. Each round resolves the calls all of whose predecessors are resolved, so there
    are as many rounds as levels; what a cycle holds back gets no row."""
    edges = calls.where("conv_id is not null").select("row", "conv_id", F.explode(F.array_distinct("after")).alias("call_id"))
    known = written(edges.join(calls.where("first").select(*_KEY, F.col("row").alias("parent")), [*_KEY]).select("row", "parent"))
    needs = known.groupBy("row").agg(F.count("*").alias("needed"))
    done = written(calls.join(needs, "row", "left_anti").select("row", F.lit(0).alias("level")))
    waiting, total = needs, done.count()
    while True:
        met = known.join(done.withColumnRenamed("row", "parent"), "parent").groupBy("row").agg(F.count("*").alias("met"), (F.max("level") + 1).alias("level"))
        ready = met.join(waiting, "row").where("met = needed").join(done, "row", "left_anti").select("row", "level")
        done = written(done.unionByName(ready))
        count = done.count()
        if count == total:
            return done
        total = count


def errors(arguments: Column, values: Column, params: Column) -> Column:
    """Texts on what a map of JSON texts lacks, has too much, or has of a wrong kind against params (name, kind,
    required). values are the texts as they are written, and judged; a text that isn't JSON is of no kind."""
    names = F.transform(params, lambda p: p["name"])
    lacks = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(F.map_keys(arguments), p["name"])), lambda p: F.concat(F.lit("missing "), p["name"]))
    extra = F.transform(F.array_except(F.map_keys(arguments), names), lambda n: F.concat(F.lit("unknown "), n))

    def wrong(p: Column) -> Column:
        text, value = F.element_at(arguments, p["name"]), F.element_at(values, p["name"])
        fits = F.lit(False)
        for kind, pattern in KINDS.items():
            fits = fits | ((p["kind"] == kind) & value.rlike(pattern))
        return text.isNotNull() & ~(fits & (value != quoted(text)))

    return F.array_sort(F.concat(lacks, extra, F.transform(F.filter(params, wrong), lambda p: F.concat(F.lit("kind of "), p["name"]))))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result that isn't the first of a call.

    calls: conv_id, call_id, turn, tool, arguments map<string,string>, after array<string>; results: conv_id, call_id,
    turn, content; schemas: tool, name, kind, required (a few rows per tool). Returns conv_id, call_id, turn, tool,
    level, n_results, status, errors, json; sorted by (level, turn, call_id) a conversation's calls are in topological
    order. Status of calls: duplicate call (another one has its id and comes first), cyclic, unknown tool, invalid
    (arguments), unlinkable (no conv_id or call_id), early (the result comes before its call), unanswered, else
    linked; of results: unlinkable, duplicate result (another one has its id and comes first), orphan (no call).
    Defined results: null ids match nothing, and each such row stands for itself; of calls with the same id the first
    by turn and JSON is linked and is what `after` means, of results the first by turn and content; the others have
    rows with their own JSON. Of results equal in all columns with an id there is one row; n_results counts all
    results of an id in the row of the first, and the equal ones in the row of another. Null arguments are an empty
    object; a null result is the text null; empty tables give no rows. Columns of other names are ignored."""
    empty = F.create_map().cast("map<string,string>")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*_KEY, "turn", "tool", F.coalesce("arguments", empty).alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    calls = calls.withColumns({"values": F.transform_values("arguments", lambda _, v: value_of(v)), "row": F.monotonically_increasing_id()})
    calls = written(calls.withColumn("args", canonical(F.col("values"))))
    order = F.struct("turn", "args", "tool", F.map_entries("arguments").alias("entries"), "after", "row")
    first = calls.where(has_id).groupBy(*_KEY).agg(F.min(order).alias("c")).select("c.row", F.lit(True).alias("first"))
    calls = written(calls.join(first, "row", "left").withColumn("first", F.coalesce("first", F.lit(False))))

    params = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "required"))).alias("params"))
    checked = calls.join(params, "tool", "left").join(levels(calls), "row", "left")
    checked = checked.select(*_KEY, "turn", "tool", "args", "level", "first", F.lit(True).alias("called"), F.col("params").isNotNull().alias("declared"), F.coalesce(errors(F.col("arguments"), F.col("values"), F.col("params")), F.array().cast("array<string>")).alias("errors"))

    results = results.select(*_KEY, F.col("turn").alias("result_turn"), "content")
    copies = results.where(has_id).groupBy(*_KEY, "result_turn", "content").agg(F.count("*").alias("n"))
    heads = copies.groupBy(*_KEY).agg(F.min(F.struct("result_turn", "content")).alias("r"), F.sum("n").alias("n")).select(*_KEY, "r.*", "n")
    further = copies.alias("x").join(heads.alias("h"), _same("x", "h", *_KEY, "result_turn", "content"), "left_anti").withColumn("further", F.lit(True))
    lost = results.where(~has_id).withColumns({"n": F.lit(1).cast("long"), "further": F.lit(False)})

    joined = checked.where("first").hint("shuffle_hash").join(heads.withColumn("further", F.lit(False)), [*_KEY], "full_outer")
    every = checked.where("not first").unionByName(further.unionByName(lost), allowMissingColumns=True).unionByName(joined, allowMissingColumns=True)
    status = (
        F.when(F.col("called").isNull(), F.when(~has_id, "unlinkable").when(F.col("further"), "duplicate result").otherwise("orphan"))
        .when(has_id & ~F.col("first"), "duplicate call").when(F.col("level").isNull(), "cyclic").when(~F.col("declared"), "unknown tool").when(F.size("errors") > 0, "invalid")
        .when(~has_id, "unlinkable").when(F.col("result_turn") < F.col("turn"), "early").when(F.col("n").isNull(), "unanswered").otherwise("linked")
    )
    body = F.create_map(
        F.lit("arguments"), F.coalesce("args", F.lit("null")), F.lit("id"), quoted(F.col("call_id")),
        F.lit("name"), quoted(F.col("tool")), F.lit("result"), F.when(F.col("n").isNotNull(), quoted(F.col("content"))).otherwise("null"),
    )
    turn = F.when(F.col("called").isNull(), F.col("result_turn")).otherwise(F.coalesce("turn", "result_turn"))
    return every.select(*_KEY, turn.alias("turn"), "tool", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), canonical(body).alias("json"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each assistant turn t is call `c<t>` of tool `draft` (over 100 words)
    or `reply`, to come after the call of turn t div 2; each later user turn t is the result of call `c<t-1>`."""
    words, lines = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1
    base = F.create_map(F.lit("text"), quoted(F.col("text")), F.lit("words"), words.cast("string"))
    arguments = F.when(lines > 1, F.map_concat(base, F.create_map(F.lit("lines"), lines.cast("string")))).otherwise(base)
    turn = F.col("turn").cast("long")
    calls = conversations.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), "turn", F.when(words > 100, "draft").otherwise("reply").alias("tool"), arguments.alias("arguments"), F.array(F.concat(F.lit("c"), F.floor(turn / 2).cast("string"))).alias("after"))
    calls = calls.withColumn("after", F.array_except("after", F.array("call_id")))
    results = conversations.where("role = 'user' and turn > 0").select("conv_id", F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def turn_schemas(spark: SparkSession) -> DataFrame:
    rows = [("draft", "lines", "integer", True), ("draft", "text", "string", True), ("draft", "words", "integer", True), ("reply", "text", "string", True), ("reply", "words", "integer", True)]
    one = lambda r: f"SELECT '{r[0]}' AS tool, '{r[1]}' AS name, '{r[2]}' AS kind, {str(r[3]).lower()} AS required"
    return spark.sql(" UNION ALL ".join(map(one, rows)))


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, tool, level, n_results, status, errors as text and json_sha256 of all turns as calls."""
    linked = link(*turns_as_calls(conversations), turn_schemas(conversations.sparkSession))
    return linked.select("conv_id", "call_id", "turn", "tool", "level", "n_results", "status", F.array_join("errors", ";").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE a AS (SELECT conv_id, turn, text, 'c' || turn AS call_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS words,
  coalesce(length(text) - length(replace(text, chr(10), '')), 0) + 1 AS lines, CAST(floor(turn / 2) AS BIGINT) AS up FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, CASE WHEN words > 100 THEN 'draft' ELSE 'reply' END AS tool, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS quoted FROM a),
c AS (SELECT *, '{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END || '"text":' || quoted || ',"words":' || words || '}' AS args FROM b),
l AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.up AND c.up <> c.turn)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.up = l.turn AND c.up <> c.turn),
r AS (SELECT conv_id, turn, text AS content, 'c' || (turn - 1) AS call_id FROM conversations WHERE role = 'user' AND turn > 0),
e AS (SELECT c.*, l.level, concat_ws(';', CASE WHEN text IS NULL THEN 'kind of text' END, CASE WHEN tool = 'draft' AND lines = 1 THEN 'missing lines' END, CASE WHEN tool = 'reply' AND lines > 1 THEN 'unknown lines' END) AS errors
  FROM c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn)
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, coalesce(e.turn, r.turn) AS turn, e.tool, CAST(e.level AS INTEGER) AS level,
  CAST(CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
  CASE WHEN e.call_id IS NULL THEN 'orphan' WHEN e.errors <> '' THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(e.errors, '') AS errors,
  sha256('{"arguments":' || coalesce(e.args, 'null') || ',"id":"' || coalesce(e.call_id, r.call_id) || '","name":' || CASE WHEN e.tool IS NULL THEN 'null' ELSE '"' || e.tool || '"' END
    || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}') AS json_sha256
FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
"""
