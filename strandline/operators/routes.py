"""Route patterns and the URLs that meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a segment that stands for any: [id], :id, {id}, <id>
PARAM = r"^(?:\[.+\]|:.+|\{.+\}|<.+>)$"


def normal_url(url: Column) -> Column:
    """Path of a URL: without host, query, fragment, and slashes at the end; a
    template slot is a parameter."""
    u = F.regexp_replace(url, r"^[a-z]+://[^/]+", "")
    u = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"\$\{[^}]*\}", "[slot]")
    return F.concat(F.lit("/"), F.regexp_replace(u, "^/+|/+$", ""))


def next_route(path: Column) -> Column:
    """URL of a file by folder conventions (app/**/route.*, pages/api/**), groups
    in brackets left out; null for other files."""
    app = F.regexp_extract(path, r"(?:^|/)app/(.*?)/?route\.\w+$", 1)
    pages = F.regexp_extract(path, r"(?:^|/)pages/(api/.*)\.\w+$", 1)
    url = F.when(path.rlike(r"(?:^|/)app/(?:.*/)?route\.\w+$"), app).when(path.rlike(r"(?:^|/)pages/api/.*\.\w+$"), F.regexp_replace(pages, "/index$", ""))
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(url, r"\([^)]*\)/?", ""), "^/+|/+$", ""))


def match_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """(project_id, url) with (project_id, route): a route meets a URL of as many
    segments if each is equal or one of both is a parameter; of several the one
    with most equal segments, then the first by name.

    Joined on project, number of segments and first plain segment (a route that
    begins with a parameter is joined on the number alone), so no product of
    all routes and URLs is made.
    """
    seg = lambda c: F.split(F.regexp_replace(c, "^/", ""), "/")
    u = urls.select("project_id", "url", seg("url").alias("us")).distinct().withColumn("n", F.size("us"))
    r = routes.select("project_id", "route", seg("route").alias("rs")).distinct().withColumn("n", F.size("rs"))
    first = F.get("rs", F.lit(0))
    r = r.withColumn("k", F.when(first.rlike(PARAM), F.lit("")).otherwise(first))
    u = u.withColumn("k", F.explode(F.array_distinct(F.array(F.get("us", F.lit(0)), F.lit("")))))
    same = F.zip_with("us", "rs", lambda a, b: F.when(a == b, 2).when(a.rlike(PARAM) | b.rlike(PARAM), 1).otherwise(0))
    j = u.join(r, ["project_id", "n", "k"]).withColumn("s", same).filter(~F.exists("s", lambda x: x == 0))
    score = F.size(F.filter("s", lambda x: x == 2))
    best = j.groupBy("project_id", "url").agg(F.min(F.struct((-score).alias("s"), "route")).alias("b"))
    return best.select("project_id", "url", F.col("b.route").alias("route"))
