"""Readings named in free text, by scanning typed tokens.

A message is split to clauses and a clause to tokens: numbers, words, signs, #tags and @places. The vocabulary packs give words their type: the name of a metric
(one or several words), a unit, a value word. Names are then paired with what stands next to them once units and filler are set aside:

    name, number      "gate clicks: 12 n"        number, name      "12 n of clicks"
    name .. word      "clicks very many"         word, name        "many clicks"

A name with neither is a flag, if its metric is one, or an error. Windows run inside one clause, so nothing here meets other messages.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gossamer.functions import scalars as X
from gossamer.plans.bounded import dealt, spread
from gossamer.sources.vocab import convert_unit

TOKEN = r"[#@][\p{L}\p{N}_.-]+|-?(?:\p{N}+(?:\.\p{N}+)?|\.\p{N}+)|[\p{L}_]+|\S"
FILLER = [":", "=", "of"]
# Minutes in each unit of "<number> <unit> ago".
SPANS = {"m": 1.0, "min": 1.0, "mins": 1.0, "minute": 1.0, "minutes": 1.0, "h": 60.0, "hr": 60.0, "hrs": 60.0, "hour": 60.0, "hours": 60.0}
TASK_BYTES = 2**18  # scanned bytes a task; its sorted tokens take some hundred times as many
REACH = 4  # tokens between a name and its value word


def spelled(name: str) -> str:
    """A vocabulary name as its tokens."""
    return " ".join(re.findall(r"-?(?:\d+(?:\.\d+)?|\.\d+)|[^\W\d]+|\S", name.lower()))


def _in(c: Column, words) -> Column:
    return c.isin(*words) if words else F.lit(False)


def tokens(messages: DataFrame, message_id: str) -> DataFrame:
    """One row per token: (message, clause, note, pos, tok), lower-cased. What follows a spaced double dash is the clause's note."""
    c = spread(messages.select(message_id, "text")).select(message_id, F.posexplode(F.split("text", r"[;\n]")).alias("clause", "_c")).filter(F.trim("_c") != "")
    halves = F.split("_c", r"\s+(?:--|—)\s+", 2)
    c = c.select(message_id, "clause", F.nullif(F.trim(F.get(halves, F.lit(1))), F.lit("")).alias("note"), F.get(halves, F.lit(0)).alias("_t"))
    return c.select(message_id, "clause", "note", F.posexplode(F.regexp_extract_all(F.lower("_t"), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))


def extract_readings(messages: DataFrame, message_id: str, vocab: dict[str, list], dim_metric: DataFrame, dim_unit: DataFrame, dim_word: DataFrame) -> DataFrame:
    """(message, clause, metric, value, minutes_ago, place, note, tags, error). ``vocab``: aliases (alias, metric, is_flag), units and words of the packs."""
    spark = messages.sparkSession
    key = [message_id, "clause"]
    line, whole = W.partitionBy(*key).orderBy("pos"), W.partitionBy(*key)
    t = dealt(tokens(messages, message_id), key, TASK_BYTES)

    # what concerns the whole clause: time, tags, place
    number = F.col("tok").rlike(r"^-?\.?\p{N}")
    span = F.lead("tok").over(line)
    minutes = F.coalesce(*[F.when(span == u, F.lit(m)) for u, m in SPANS.items()])
    t = t.withColumn("_ago", F.when(number & (F.lead("tok", 2).over(line) == "ago"), F.col("tok").try_cast("double") * minutes))
    spent = F.coalesce(F.col("_ago").isNotNull() | F.lag("_ago").over(line).isNotNull() | F.lag("_ago", 2).over(line).isNotNull(), F.lit(False))
    tag, place = F.col("tok").startswith("#") & (F.length("tok") > 1), F.col("tok").startswith("@") & (F.length("tok") > 1)
    t = t.withColumns({"_spent": spent | tag | place, "minutes_ago": F.first("_ago", ignorenulls=True).over(whole),
                       "tags": F.collect_list(F.when(tag, F.substr("tok", F.lit(2)))).over(whole), "place": F.first(F.when(place, F.substr("tok", F.lit(2))), ignorenulls=True).over(whole)})
    t = t.filter(~F.col("_spent")).withColumn("pos", F.row_number().over(line))

    # names: the longest one that starts at a token; one that starts inside an earlier name is part of it
    named: dict[int, list] = {}
    for alias, metric, is_flag in vocab["aliases"]:
        text = spelled(alias)
        named.setdefault(text.count(" ") + 1, []).append((text, metric))
    for n, rows in sorted(named.items()):
        text = F.concat_ws(" ", *[F.lead("tok", k).over(line) for k in range(n)])
        table = spark.createDataFrame(sorted(set(rows)), f"_s{n} string, _m{n} string")
        t = t.withColumn(f"_s{n}", text).join(F.broadcast(table), f"_s{n}", "left").drop(f"_s{n}")
    sizes = sorted(named, reverse=True)
    t = t.withColumns({"metric": F.coalesce(*[F.col(f"_m{n}") for n in sizes]), "_len": F.coalesce(*[F.when(F.col(f"_m{n}").isNotNull(), n) for n in sizes], F.lit(0))})
    before = line.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_inside", F.coalesce(F.max(F.when(F.col("_len") > 0, F.col("pos") + F.col("_len") - 1)).over(before) >= F.col("pos"), F.lit(False))).filter(~F.col("_inside"))

    # numbers with their unit, value words, and everything else
    words = vocab["words"]
    word = F.when(_in(F.col("tok"), words), F.col("tok")).when(_in(F.regexp_replace("tok", "s$", ""), words), F.regexp_replace("tok", "s$", ""))
    is_unit = _in(F.col("tok"), [u.lower() for u in vocab["units"]])
    number = F.col("tok").rlike(r"^-?\.?\p{N}")
    t = t.withColumns({"unit": F.when(number & F.lead(is_unit).over(line), F.lead("tok").over(line)), "_taken": F.coalesce(is_unit & F.lag(number).over(line), F.lit(False))})
    kind = F.when(F.col("_len") > 0, "name").when(number, "number").when(word.isNotNull(), "word").otherwise("other")
    t = t.filter(~F.col("_taken") & ~((F.col("_len") == 0) & _in(F.col("tok"), FILLER))).withColumns({"kind": kind, "word": word})

    # a value word belongs to the name or number that leads its stretch of the clause
    t = t.withColumn("_stretch", F.sum(F.col("kind").isin("name", "number").cast("int")).over(line))
    stretch = W.partitionBy(*key, "_stretch")
    t = t.withColumns({"_head": F.min(F.when(F.col("kind").isin("name", "number"), F.struct("pos", "kind"))).over(stretch), "_said": F.min(F.when(F.col("kind") == "word", F.struct("pos", "word"))).over(stretch)})
    item = F.struct("kind", F.col("tok").alias("num"), "unit", "word", (F.coalesce("_head.kind", F.lit("")) == "name").alias("led"), F.col("pos").alias("at"), F.col("_head.pos").alias("since"))
    t = t.withColumns({"_next": F.lead(item).over(line), "_prev": F.lag(item).over(line), "_prev2": F.lag("kind", 2).over(line)}).filter("kind = 'name'")
    after = F.col("_next.kind") == "number"
    said = F.col("_said").isNotNull() & (F.col("_said.pos") - F.col("pos") <= REACH + F.col("_len"))
    ahead = (F.col("_prev.kind") == "number") & (F.coalesce("_prev2", F.lit("")) != "name")
    led = (F.col("_prev.kind") == "word") & (~F.col("_prev.led") | (F.col("_prev.at") - F.col("_prev.since") > REACH + 1))
    how = F.when(F.coalesce(after, F.lit(False)), "after").when(said, "said").when(F.coalesce(ahead, F.lit(False)), "ahead").when(F.coalesce(led, F.lit(False)), "led").otherwise("bare")
    r = t.withColumn("how", how).select(
        *key, "note", "tags", "minutes_ago", "place", "metric", "how",
        F.when(F.col("how") == "after", F.col("_next.num")).when(F.col("how") == "ahead", F.col("_prev.num")).try_cast("double").alias("raw_value"),
        F.when(F.col("how") == "after", F.col("_next.unit")).when(F.col("how") == "ahead", F.col("_prev.unit")).alias("unit"),
        F.when(F.col("how") == "said", F.col("_said.word")).when(F.col("how") == "led", F.col("_prev.word")).alias("word"))

    r = convert_unit(r.join(F.broadcast(dim_metric.select("metric", "lo", "hi")), "metric"), dim_unit, dim_metric)
    r = r.join(F.broadcast(dim_word.withColumnRenamed("value", "_wv")), ["metric", "word"], "left")
    worded = F.col("how").isin("said", "led")
    r = r.withColumn("value", F.when(worded & ~F.col("is_flag"), F.col("_wv")).otherwise(F.col("value")))
    error = (F.when((F.col("how") == "bare") & ~F.col("is_flag"), "give a value").when(F.col("error").isNotNull(), F.col("error")).when(F.col("value").isNull(), "unknown word")
             .when(~F.col("is_flag") & ~X.in_range("value", "lo", "hi"), "outside plausible range"))
    return r.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), F.col("value"))).select(*key, "metric", "value", "minutes_ago", "place", "note", "tags", "error")
