"""Connected groups of items that share candidate buckets, without making all pairs of a bucket.

Only groups are wanted, so two items already known to be connected need no test. Each round tests every member of an
unresolved bucket against a few hubs of that bucket, joins what is confirmed, and then drops the hubs (all their pairs
are tested) and the buckets that lie in one group. The number of hubs grows eightfold (growth) a round, so a bucket of k
members that are all unlike each other is fully tested after about log8(k) rounds; a bucket of near copies is
resolved in the first ones with work in proportion to its size. No pair of a bucket is skipped unless its two items
are connected already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Work


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(item, component) of every item in edges (a, b): the least item reachable. Min-label steps with pointer jumping."""
    both = work.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work.cut(both.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("item")).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, F.col("item") == F.col("a")).select("item", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("item").alias("component"), F.col("component").alias("root"))
        step = moved.join(jump, "component").select("item", "old", F.least("component", "root").alias("component"))
        step = work.cut(step)
        changed = step.where("old <> component").limit(1).count()
        work.drop(labels)
        labels = step.select("item", "component")
        labels._cut_path = step._cut_path
        if not changed:
            work.drop(both)
            return labels


class Groups:
    """Links confirmed so far, and the groups that they form."""

    def __init__(self, work: Work, verify: Callable[[DataFrame], DataFrame], traits: DataFrame | None = None, near: Callable[[Column, Column], Column] | None = None, growth: int = 8) -> None:
        """verify: takes distinct pairs (a, b), a < b, and returns those that are links.

        traits: (item, trait) of every item, for near(trait, trait), which must hold of every link; later rounds make no other pairs.
        growth: times as many hubs each round.
        """
        self.work, self.verify, self.traits, self.near, self.growth = work, verify, traits, near, growth
        self.kind = "long" if traits is None else traits.schema["trait"].dataType.simpleString()
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def table(self) -> DataFrame:
        """(item, component) of the items that some link touches."""
        return self.work.spark.createDataFrame([], "item long, component long") if self.labels is None else self.labels

    def add(self, links: DataFrame) -> None:
        """Join the groups that links (a, b) connect: only the groups they touch are labelled again."""
        if self.labels is None:
            self.labels = components(self.work, links)
            return
        to = lambda end: self.labels.select(F.col("item").alias(end), F.col("component").alias(f"c{end}"))
        over = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = self.work.cut(over.where("a <> b").distinct())
        if over.isEmpty():
            return
        moved = components(self.work, over)
        fresh = moved.join(self.labels.select("item"), "item", "left_anti")
        known = self.labels.join(moved.select(F.col("item").alias("component"), F.col("component").alias("root")), "component", "left")
        old, self.labels = self.labels, self.work.cut(known.select("item", F.coalesce("root", "component").alias("component")).unionByName(fresh))
        self.work.drop(old)

    def resolve(self, members: DataFrame, rounds: int | None = None, hubs: int = 1) -> DataFrame | None:
        """Test the pairs within buckets. Returns what ``rounds`` rounds leave untested, if any.

        members: distinct (bucket, item) and perhaps side: 0 is tested against 1 only, 2 (the default) against all.
        """
        work, sided = self.work, "side" in members.columns
        members = members if "side" in members.columns else members.withColumn("side", F.lit(2))
        while rounds is None or rounds > 0:
            rounds = None if rounds is None else rounds - 1
            now = members.withColumns({"component": F.col("item"), "trait": F.lit(None).cast(self.kind)})
            if self.labels is None and hubs == 1 and not sided:
                live = members.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo < hi")
                live = live.select("bucket", F.array(F.struct(F.col("lo").alias("item"), F.lit(2).alias("side"), F.col("lo").alias("component"), F.lit(None).cast(self.kind).alias("trait"))).alias("hubs"))
            else:
                if self.labels is not None:
                    now = now.drop("component").join(self.labels, "item", "left").withColumn("component", F.coalesce("component", "item"))
                if self.traits is not None:
                    now = now.drop("trait").join(self.traits, "item", "left")
                salt = F.pmod(F.xxhash64("item"), F.lit(hubs))
                live = now.groupBy("bucket", "side", salt.alias("salt")).agg(F.min(F.struct("item", "side", "component", "trait")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                live = live.groupBy("bucket").agg(F.collect_list("hub").alias("hubs"), F.min("hub.side").alias("s0"), F.max("hub.side").alias("s1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                live = live.where("lo < hi AND (s0 < s1 OR s1 = 2)").select("bucket", "hubs")

            def asked(h: Column) -> Column:
                """Is the pair of a member and hub h one to test?"""
                ok = (h["component"] != F.col("component")) & ((h["side"] != F.col("side")) | (h["side"] == 2))
                return ok if self.near is None else ok & F.coalesce(self.near(h["trait"], F.col("trait")), F.lit(True))

            is_hub = F.exists("hubs", lambda h: (h["item"] == F.col("item")) & (h["side"] == F.col("side")))
            others = F.transform(F.filter("hubs", asked), lambda h: h["item"])
            left = work.cut(now.join(live, "bucket").select("bucket", "item", "side", is_hub.alias("is_hub"), others.alias("hubs")))
            if hasattr(members, "_cut_path"):
                work.drop(members)
            if left.isEmpty():
                return None
            pairs = left.select("item", F.explode("hubs").alias("hub"))
            pairs = pairs.select(F.least("item", "hub").alias("a"), F.greatest("item", "hub").alias("b")).distinct()
            pairs = pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")
            pairs = work.cut(pairs)
            self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
            links = work.cut(self.verify(pairs).select("a", "b"))
            self.add(links)
            work.drop(links)
            members = work.cut(left.where("NOT is_hub").select("bucket", "item", "side"))
            work.drop(left)
            hubs *= self.growth
        return members
