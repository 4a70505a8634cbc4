"""Robots rules as rows: the longest matching rule of the most specific agent group decides, and allowing wins ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(files: DataFrame) -> DataFrame:
    """files (host, body) to rules (host, agent, allow, pattern), an agent without rules having one null pattern.

    Consecutive user-agent lines share the rules that follow them; an empty disallow is no rule.
    """
    line = files.select("host", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "line"))
    bare = F.trim(F.substring_index("line", "#", 1))
    line = line.withColumn("field", F.lower(F.trim(F.substring_index(bare, ":", 1)))).withColumn("value", F.trim(F.regexp_replace(bare, r"^[^:]*:", ""))).where(F.contains(bare, F.lit(":")) & F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("pos")
    line = line.withColumn("is_agent", F.col("field") == "user-agent")
    opens = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(w), F.lit(False))
    line = line.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("block > 0")
    agents = line.where("is_agent and value != ''").select("host", "block", F.lower("value").alias("agent")).distinct()
    rules = line.where("not is_agent and value != ''").select("host", "block", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(rules, ["host", "block"], "left").select("host", "agent", "allow", "pattern")


def _expression(pattern: Column) -> Column:
    """A robots pattern as a regex: * is anything, a final $ ends the target."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$\z", ""), r"([\\.+?()\[\]{}^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), r"\z").otherwise(""))


def allowed(targets: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """targets (host, target: path and query) with can_fetch; a host without rules allows all."""
    product = user_agent.split()[0].split("/", 1)[0].lower()
    fits = F.when(F.col("agent") == "*", 0).when(F.contains(F.lit(product), F.col("agent")), F.length("agent"))
    own = rules.withColumn("fit", fits).where("fit is not null").withColumn("best", F.max("fit").over(Window.partitionBy("host"))).where("fit = best and pattern is not null")
    t = targets.select("host", "target").distinct()
    hits = t.join(own.select("host", "allow", "pattern"), "host").where(F.rlike("target", _expression(F.col("pattern"))))
    length = F.length(F.regexp_replace("pattern", r"\$+\z", ""))
    won = hits.groupBy("host", "target").agg(F.max(F.struct(length.alias("n"), F.col("allow").alias("allow"))).alias("w")).select("host", "target", F.col("w.allow").alias("_allow"))
    return targets.join(won, ["host", "target"], "left").withColumn("can_fetch", F.coalesce("_allow", F.lit(True))).drop("_allow")
