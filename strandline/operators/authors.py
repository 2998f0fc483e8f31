"""Authors told apart by initial and last name, and by shared mailboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components_by


def name_key(name: Column, email: Column) -> Column:
    """First initial and last name (one word stays as it is; a last word of one
    letter gives way to the one before); without a name the words before the @."""
    text = F.when(name.contains("@"), F.split_part(name, F.lit("@"), F.lit(1))).otherwise(name)
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")
    w = F.filter(F.split(clean, r"[\s-]+"), lambda x: x != "")
    n = F.size(w)
    last = F.get(w, n - 1)
    last = F.when((F.length(last) < 2) & (n >= 3), F.get(w, n - 2)).otherwise(last)
    by_name = F.when(n == 0, F.lit("")).when(n == 1, F.get(w, F.lit(0))).otherwise(F.concat(F.substring(F.get(w, F.lit(0)), 1, 1), F.lit(" "), last))
    by_mail = F.trim(F.regexp_replace(F.lower(F.split_part(email, F.lit("@"), F.lit(1))), "[._-]", " "))
    return F.nullif(F.when(F.coalesce(name, F.lit("")) != "", by_name).otherwise(by_mail), F.lit(""))


def dedup(records: DataFrame) -> DataFrame:
    """(name, email, commit_count) -> author, canonical, names, emails, commits.
    Records of one key are one author, and keys that share a mailbox are too;
    the longest name is canonical (ties: the first in order). Records without a
    key are left out. Merging is by connected components, so it doesn't depend
    on the order of the records."""
    r = records.select(name_key(F.col("name"), F.col("email")).alias("key"), F.trim("name").alias("name"), "email", "commit_count").filter("key IS NOT NULL")
    mail = r.filter("email IS NOT NULL AND email <> ''").select("key", "email").distinct()
    link = mail.join(mail.groupBy("email").agg(F.min("key").alias("low")), "email").select(F.col("key").alias("a"), F.col("low").alias("b"))
    root = components_by(link, [], "a", "b").withColumnRenamed("node", "key")
    j = r.join(root, "key", "left").withColumn("author", F.coalesce("root", "key"))
    named = F.when(F.col("name") != "", F.struct((-F.length("name")).alias("l"), "name"))
    return j.groupBy("author").agg(
        F.coalesce(F.min(named)["name"], F.first("author")).alias("canonical"), F.countDistinct(F.nullif("name", F.lit(""))).alias("names"),
        F.countDistinct(F.nullif("email", F.lit(""))).alias("emails"), F.sum("commit_count").alias("commits"),
    )
