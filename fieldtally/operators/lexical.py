"""Lexical retrieval over an index: exact top-k by upper bounds, without a task meeting every case.

A case's score for a task is the weight of the schema parts that they share
(the schema itself, fields, tags, names), half a point for each shared term up
to twelve, two points for its domain, less its length.

1. The index keeps the cases with a key of their schema profile, of their group
   (profile and domain) and a band of length; postings lead from each schema
   part to the profiles that have it, of which there are few against the cases.
2. A task's postings give its profiles' shares.  The profiles of the k best
   cases by that share bound the k-th score from below; a profile further below
   than terms, domain and length together can make up is left out.
3. A few cases of the best groups, those of the most promising terms and
   lengths, are scored.  The k-th of these is a bound for all others: a group's
   cases need come in only up to the length at which a full count of terms could
   still reach it.
4. Only such cases, found by group and band of length, are scored.  A task whose
   bound lies so low that terms or the domain alone could reach it takes the
   cases of all its terms' postings as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.sizes import small
from ..sources.files import durable

#: What a shared part of the schema counts, by the column that holds it.
PARTS = {"fingerprint": 100.0, "fields": 8.0, "tags": 4.0, "names": 2.0}
PER_TERM, MOST_TERMS, PER_DOMAIN, CHARS, MOST_LENGTH = 0.5, 12, 2.0, 10_000.0, 2.0
#: What terms, domain and length can change at most.
TERMS, REST = PER_TERM * MOST_TERMS, PER_TERM * MOST_TERMS + PER_DOMAIN + MOST_LENGTH
#: Characters of a band of length, cases of a group that are scored first, and groups of a task whose first cases are.
BAND, FIRST_CASES, FIRST_GROUPS = 64, 16, 12
LAST_BAND = int(MOST_LENGTH * CHARS) // BAND
EPSILON = 1e-6


def _length(n_chars: Column | str) -> Column:
    return F.least(F.col(n_chars) / CHARS if isinstance(n_chars, str) else n_chars / CHARS, F.lit(MOST_LENGTH))


def _profile_key() -> Column:
    parts = [F.to_json(F.struct(F.array_sort(F.array_distinct(F.col(c))).alias("x"))) if c != "fingerprint" else F.col(c) for c in PARTS]
    return F.sha1(F.concat_ws("\u0001", *parts))


def _parts(profiles: DataFrame, key: str) -> DataFrame:
    """(key, kind, value) of every schema part."""

    def of(c: str) -> Column:
        values = F.array_distinct(F.col(c)) if c != "fingerprint" else F.array(c)
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value")))

    return profiles.select(key, F.explode(F.concat(*map(of, PARTS))).alias("p")).select(key, "p.kind", "p.value").where("value is not null")


def shared_terms(a: Column | str, b: Column | str) -> Column:
    return PER_TERM * F.least(F.size(F.array_intersect(a, b)), F.lit(MOST_TERMS))


def domain_words(domain: Column | str) -> Column:
    return text.terms(F.replace(domain, F.lit("_"), F.lit(" ")))


@dataclass
class LexicalIndex:
    """Cases by group and band, and the parts of their profiles."""

    cases: DataFrame
    profiles: DataFrame
    parts: DataFrame
    groups: DataFrame

    @staticmethod
    def build(cases: DataFrame, largest: int | None = None) -> LexicalIndex:
        """``cases`` have (case_id, n_chars, domain, fingerprint, fields, tags, names, terms); with ``largest`` only those of at most so many characters."""
        fitting = cases if largest is None else cases.where(F.col("n_chars") <= largest)
        band = F.floor(_length("n_chars") * CHARS / BAND).cast("int")
        rows = fitting.select("case_id", "n_chars", "domain", "terms", *PARTS, _profile_key().alias("profile"), band.alias("band"))
        rows = durable(rows.withColumn("group", F.sha1(F.concat_ws("\u0001", "profile", F.coalesce("domain", F.lit(""))))))
        profiles = rows.groupBy("profile").agg(*[F.first(c).alias(c) for c in PARTS], F.count("*").alias("n"))
        groups = rows.groupBy("profile", "group", "domain").agg(F.count("*").alias("n"))
        cases = rows.drop(*PARTS)
        return LexicalIndex(cases, durable(profiles), durable(_parts(profiles, "profile")), durable(groups))

    def first_cases(self) -> DataFrame:
        """A few cases of every group, those that could score highest."""
        promise = PER_TERM * F.least(F.size("terms"), F.lit(MOST_TERMS)) - _length("n_chars")
        order = Window.partitionBy("group").orderBy(F.desc(promise), "case_id")  # Spark keeps a few a partition before it shuffles
        return self.cases.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= FIRST_CASES).drop("__r")

    def shares(self, tasks: DataFrame, k: int) -> DataFrame:
        """(mine, profile, share) of the profiles that can hold one of a task's k best, by the key of the task's profile."""
        own = tasks.groupBy("mine").agg(*[F.first(c).alias(c) for c in PARTS])
        weight = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
        met = _parts(own, "mine").join(self.parts, ["kind", "value"]).groupBy("mine", "profile").agg(F.sum(F.element_at(weight, F.col("kind"))).alias("share"))
        met = met.join(self.profiles.select("profile", "n"), "profile")
        so_far = F.sum("n").over(Window.partitionBy("mine").orderBy(F.desc("share"), "profile").rowsBetween(Window.unboundedPreceding, 0))
        counted = durable(met.withColumn("so_far", so_far))
        kth = counted.groupBy("mine").agg(F.max(F.when(F.col("so_far") >= k, F.col("share"))).alias("kth"))
        near = counted.join(kth, "mine").where(F.col("kth").isNull() | (F.col("share") >= F.col("kth") - REST - EPSILON))
        return durable(near.select("mine", "profile", "share"))

    def search(self, tasks: DataFrame, k: int) -> DataFrame:
        """(task_id, case_id, score, place) of every task's k best cases with a score above 0; ``tasks`` have a profile as cases do."""
        tasks = durable(tasks.select("task_id", "terms", *PARTS, _profile_key().alias("mine")))
        near = self.shares(tasks, k)
        said = tasks.select("task_id", F.explode("terms").alias("word"))
        domains = self.groups.select("domain").distinct().select("domain", F.explode(domain_words("domain")).alias("word"))
        told = said.join(domains, "word").select("task_id", "domain").distinct().withColumn("told", F.lit(PER_DOMAIN))
        groups = tasks.select("task_id", "mine").join(near, "mine").join(self.groups, "profile").join(told, ["task_id", "domain"], "left")
        groups = durable(groups.select("task_id", "group", "n", (F.col("share") + F.coalesce("told", F.lit(0.0))).alias("base")))
        words = tasks.select("task_id", F.col("terms").alias("said"))

        def scored(pairs: DataFrame) -> DataFrame:
            score = F.col("base") + shared_terms("said", "terms") - _length("n_chars")
            return pairs.join(words, "task_id").select("task_id", "case_id", F.round(score, 9).alias("score"))

        first = Window.partitionBy("task_id").orderBy(F.desc("base"), F.desc("n"), "group")
        best = groups.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= FIRST_GROUPS).drop("__r", "n")
        tried = scored(best.join(self.first_cases(), "group")).withColumn("__r", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "case_id")))
        bounds = tasks.select("task_id").join(tried.where(F.col("__r") == k).select("task_id", F.col("score").alias("bound")), "task_id", "left")
        bounds = durable(bounds)
        spare = F.least(F.coalesce(F.col("base") + TERMS - F.col("bound"), F.lit(MOST_LENGTH)), F.lit(MOST_LENGTH)) + EPSILON  # what a length may cost
        reach = groups.join(bounds, "task_id").withColumn("spare", spare).where("spare >= 0")
        bands = reach.select("task_id", "group", "base", "spare", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("spare") * CHARS / BAND).cast("int"), F.lit(LAST_BAND)))).alias("band"))
        found = scored(bands.join(self.cases, ["group", "band"]).where(_length("n_chars") <= F.col("spare")))
        open_ = bounds.where(F.col("bound").isNull() | (F.col("bound") <= TERMS + PER_DOMAIN + EPSILON)).select("task_id")
        if not open_.isEmpty():
            found = found.unionByName(self.by_terms(tasks.join(open_, "task_id", "left_semi"))).dropDuplicates(["task_id", "case_id"])
        order = Window.partitionBy("task_id").orderBy(F.desc("score"), "case_id")
        return found.where("score > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def by_terms(self, tasks: DataFrame) -> DataFrame:
        """Scores of the cases that share a term with a task or whose domain does, by postings of the tasks' terms."""
        said = tasks.select("task_id", F.explode("terms").alias("word"))
        words = said.select("word").distinct()
        posted = self.cases.select("case_id", F.explode(F.array_union("terms", domain_words("domain"))).alias("word")).join(small(words), "word")
        pairs = said.join(posted, "word").select("task_id", "case_id").distinct()
        own = tasks.select("task_id", F.col("terms").alias("said"), *[F.col(c).alias(f"t_{c}") for c in PARTS])
        cases = self.cases.join(self.profiles.drop("n"), "profile")
        both = pairs.join(cases, "case_id").join(own, "task_id")
        share = F.when(F.col("t_fingerprint") == F.col("fingerprint"), PARTS["fingerprint"]).otherwise(0.0)
        for c in ("fields", "tags", "names"):
            share = share + PARTS[c] * F.size(F.array_intersect(c, f"t_{c}"))
        score = share + shared_terms("said", "terms") + F.when(F.arrays_overlap(domain_words("domain"), "said"), PER_DOMAIN).otherwise(0.0) - _length("n_chars")
        return both.select("task_id", "case_id", F.round(score, 9).alias("score"))


def lexical_ranked(tasks: DataFrame, cases: DataFrame, k: int = 2, largest: int | None = None) -> DataFrame:
    """The k best cases of every task, by an index built for it."""
    return LexicalIndex.build(cases, largest).search(tasks, k)
