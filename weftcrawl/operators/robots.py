"""Robots exclusion (S10, W12-W15): files are exploded into rules, agents choose a group by a grouped minimum, and the longest
matching rule wins by a grouped maximum. Rules are joined by host, so each path meets the rules of its own site only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls


def rules(files: DataFrame, netloc: str = "netloc", content: str = "content") -> DataFrame:
    """(netloc, group_id, agent, kind, pattern). Agent lines that follow each other share a group; rules before any agent
    are for *; comments and empty Disallow lines go."""
    lines = files.select(netloc, F.posexplode(F.split(content, "\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    lines = lines.select(netloc, "n", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy(netloc).orderBy("n")
    is_agent = F.col("field") == "user-agent"
    begins = is_agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("group_id", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    agents = lines.filter(is_agent).select(netloc, "group_id", F.lower("value").alias("agent"))
    free = lines.filter("group_id = 0").select(netloc, "group_id").distinct().withColumn("agent", F.lit("*"))
    found = lines.filter(~is_agent & (F.col("value") != "")).select(netloc, "group_id", F.col("field").alias("kind"), F.col("value").alias("pattern"))
    return agents.unionByName(free).join(found, [netloc, "group_id"], "left")


def for_agent(all_rules: DataFrame, user_agent: str, netloc: str = "netloc") -> DataFrame:
    """The first group whose agent is part of the user agent, else the last * group."""
    ua = F.lit(user_agent.lower())
    named = (F.col("agent") != "*") & (F.col("agent") != "") & F.instr(ua, F.col("agent")).cast("boolean")
    pick = all_rules.groupBy(netloc).agg(F.min(F.when(named, F.col("group_id"))).alias("own"), F.max(F.when(F.col("agent") == "*", F.col("group_id"))).alias("star"))
    chosen = pick.select(netloc, F.coalesce("own", "star").alias("group_id")).filter(F.col("group_id").isNotNull())
    return all_rules.filter("pattern IS NOT NULL").select(netloc, "group_id", "kind", "pattern").distinct().join(chosen, [netloc, "group_id"])


def path_matches(path: Column, pattern: Column) -> Column:
    """A prefix match; * is any run, and each part after it is found at its first place (T8); a final $ ends the path."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    parts = F.split(body, r"\*")
    # the place after the last part found, or null
    start = F.when(F.startswith(path, F.get(parts, F.lit(0))), F.length(F.get(parts, F.lit(0))))

    def step(at: Column, part: Column) -> Column:
        place = F.call_function("locate", part, path, at + 1)
        return F.when(part == "", at).when(place > 0, place - 1 + F.length(part))

    at = F.aggregate(F.slice(parts, 2, 1_000_000), start.cast("int"), step)
    return at.isNotNull() & (~ends | (at == F.length(path)))


def allowed(requests: DataFrame, rules_of_agent: DataFrame, url: str = "url", key: str = "url", netloc: str = "netloc") -> DataFrame:
    """Requests with `allowed`; sites without rules allow all. The longest allow rule is held against the longest
    disallow rule; a tie allows."""
    paths = requests.select(F.col(url).alias("__url")).distinct().withColumns({netloc: urls.authority("__url"), "__path": F.when(urls.path("__url") == "", F.lit("/")).otherwise(urls.path("__url"))})
    hit = paths.join(rules_of_agent, netloc).filter(path_matches(F.col("__path"), F.col("pattern")))
    longest = hit.groupBy("__url").agg(*(F.max(F.when(F.col("kind") == k, F.length("pattern"))).alias(k) for k in ("allow", "disallow")))
    verdict = longest.select(F.col("__url").alias(url), (F.coalesce("allow", F.lit(-1)) >= F.coalesce("disallow", F.lit(-1))).alias("__ok"))
    exempt = urls.scheme(url).isin("data", "file")
    return requests.join(verdict, url, "left").withColumn("allowed", F.coalesce("__ok", F.lit(True)) | exempt).drop("__ok")
