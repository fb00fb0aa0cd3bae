"""Endorsement and follow edges, and closures over them, whole or bounded, for many roots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_values import text_at, variant_of, variant_once
from ..functions.uris import is_valid_did
from ..shared import shared_dir, stored

AWARD, DEFINITION, RESPONSE, FOLLOW = "app.certified.badge.award", "app.certified.badge.definition", "app.certified.badge.response", "app.certified.graph.follow"
SUBJECT_TYPE = "app.certified.defs#did"
MOST_ACCOUNTS, MOST_DEGREE, MOST_VIA, EDGES_PER_ACCOUNT = 3000, 3, 64, 64
PIECE = 1 << 20  # rows that a task makes of one issuer's edges and the roots that meet them


def subject_did(json: Column | str = "json") -> Column:
    """The DID an award names: its subject is a typed object with a valid one."""
    return subject_in(variant_of(json))


def subject_in(v: Column) -> Column:
    """The same of a parsed award."""
    did = F.try_variant_get(v, "$.subject.did", "string")
    typed = F.try_variant_get(v, "$.subject['$type']", "string") == SUBJECT_TYPE
    return F.when(typed & is_valid_did(did), did)


def issuer_allowed(definition: Column, issuer: Column) -> Column:
    """Without allowedIssuers anyone may issue; with a list only those in it; an empty list or null allows nobody."""
    v = variant_of(definition)
    listed = F.exists(F.try_variant_get(v, "$.allowedIssuers", "array<variant>"), lambda x: F.try_variant_get(x, "$.did", "string") == issuer)
    return F.try_variant_get(v, "$.allowedIssuers", "variant").isNull() | F.coalesce(listed, F.lit(False))


def endorsements(records: DataFrame) -> DataFrame:
    """Distinct (issuer, subject) of awards of endorsement badges that the issuer may give and the subject didn't reject."""
    of = lambda c: records.filter(F.col("collection") == c)
    awards = of(AWARD).select(F.col("uri").alias("award"), F.col("did").alias("issuer"), text_at("json", "badge", "uri").alias("badge"), variant_once("json").alias("v"))
    awards = awards.withColumn("subject", subject_in(F.col("v"))).drop("v")
    badges = of(DEFINITION).filter(text_at("json", "badgeType") == "endorsement").select(F.col("uri").alias("badge"), F.col("json").alias("definition"))
    rejected = of(RESPONSE).filter(text_at("json", "response") == "rejected").select(F.col("did").alias("subject"), text_at("json", "badgeAward", "uri").alias("award"))
    given = awards.filter("subject is not null and subject <> issuer").join(badges, "badge").filter(issuer_allowed(F.col("definition"), F.col("issuer")))
    return given.join(rejected, ["subject", "award"], "left_anti").select("issuer", "subject").distinct()


def limited(edges: DataFrame, most: int) -> DataFrame:
    """Edges up to `most` by (issuer, subject), each with `truncated`: whether there are more. For one caller's set of issuers."""
    first = edges.orderBy("issuer", "subject").limit(most + 1)
    n = first.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return first.orderBy("issuer", "subject").limit(most).crossJoin(F.broadcast(n))  # one row


def follows(records: DataFrame) -> DataFrame:
    """Distinct (did, subject) of follow records."""
    return records.filter(F.col("collection") == FOLLOW).select("did", text_at("json", "subject").alias("subject")).filter("subject is not null").distinct()


def placed_edges(edges: DataFrame, folder: str) -> DataFrame:
    """issuer, subject, part and `nth`: an edge's place among its issuer's, by subject.

    Edges are cut into ranges by issuer and subject, so an issuer with a third of all edges lies in a third of the ranges. Each range numbers its
    own edges, and starts where the ranges before it end: of an issuer only one row for each range is brought together.
    """
    ranged = stored(edges.repartitionByRange("issuer", "subject").withColumn("part", F.spark_partition_id()), f"{folder}/ranged")
    earlier = Window.partitionBy("issuer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("issuer", "part").agg(F.count(F.lit(1)).alias("n")).select("issuer", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("issuer", "part").orderBy("subject"))
    return ranged.withColumn("nth", own).join(starts, ["issuer", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")


def ring_edges(frontier: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """root, issuer, subject: the edges of the issuers that each root stands at; `frontier` has distinct (root, issuer).

    Of an issuer come its edges times the roots at it. Where these are more than PIECE rows, the longer of the two sides is dealt over
    pieces by a hash and the other one is repeated for each, so no task makes all of an issuer's rows.
    """
    out, met = edges.groupBy("issuer").agg(F.count(F.lit(1)).alias("out")), frontier.groupBy("issuer").agg(F.count(F.lit(1)).alias("met"))
    wide = out.join(met, "issuer").filter(F.col("out") * F.col("met") > PIECE)
    pieces = F.least(F.ceil(F.col("out") * F.col("met") / PIECE), F.greatest("out", "met")).cast("int")
    wide = stored(wide.select("issuer", (F.col("out") >= F.col("met")).alias("by_edge"), pieces.alias("pieces")), folder)
    if wide.isEmpty():
        return frontier.join(edges, "issuer").select("root", "issuer", "subject")

    def dealt(df: DataFrame, key: str, by_edge: bool) -> DataFrame:
        own = F.array(F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))
        each = F.when(F.col("pieces").isNull(), F.array(F.lit(0))).when(F.col("by_edge") == by_edge, own).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
        return df.join(wide, "issuer", "left").withColumn("piece", F.explode(each)).drop("by_edge", "pieces")

    return dealt(frontier, "root", False).join(dealt(edges, "subject", True), ["issuer", "piece"]).select("root", "issuer", "subject")


def whole_closure(edges: DataFrame, roots: DataFrame, max_degree: int = MOST_DEGREE) -> DataFrame:
    """root, did, degree, via: every account within `max_degree` steps of each root; `via` (from degree 2 on) names all predecessors of the ring before, sorted.

    The walk of `closure` without its limits: no account, edge or predecessor is left out, so nothing is numbered or ranked. A ring's rows are
    gathered by root and account, so a root that reaches very many accounts is spread. Edges are evaluated once and stored; the last ring isn't stored.
    """
    if not 1 <= max_degree <= MOST_DEGREE:
        raise ValueError(f"degree must be 1 to {MOST_DEGREE}")
    folder = shared_dir(edges.sparkSession)
    edges = stored(edges.select("issuer", "subject").filter("subject <> ''").distinct(), f"{folder}/edges")
    frontier = roots.select(F.col("did").alias("root"), F.col("did").alias("issuer")).distinct()
    found = None
    for degree in range(1, max_degree + 1):
        steps = ring_edges(frontier, edges, f"{folder}/wide-{degree}").filter("subject <> root")
        if degree == 1:  # a root's own edges: each account comes once
            ring = steps.select("root", F.col("subject").alias("did"), F.lit(degree).alias("degree"), F.expr("cast(array() as array<string>)").alias("via"))
        else:
            # What is known already is gathered with the steps, so that a ring's rows move once.
            known = found.select("root", F.lit(None).cast("string").alias("issuer"), F.col("did").alias("subject"))
            gathered = steps.unionByName(known).repartition("root", "subject").groupBy("root", "subject")
            ring = gathered.agg(F.max(F.col("issuer").isNull()).alias("known"), F.array_sort(F.collect_list("issuer")).alias("via")).filter("not known")
            ring = ring.select("root", F.col("subject").alias("did"), F.lit(degree).alias("degree"), "via")
        if degree < max_degree:
            ring = stored(ring, f"{folder}/ring-{degree}")
            frontier = ring.select("root", F.col("did").alias("issuer"))
        found = ring if found is None else found.unionByName(ring)
    return found


def closure(edges: DataFrame, roots: DataFrame, max_degree: int = MOST_DEGREE, most: int = MOST_ACCOUNTS, via: int = MOST_VIA) -> DataFrame:
    """root, did, degree, via, truncated: accounts within `max_degree` steps of each root, up to the limits of a request; `whole_closure` has none.

    A breadth-first walk of all roots at once, a join for each degree. Within a root, nodes of a degree
    come in the order of their first predecessor, then by name; at most `most` accounts are taken, and
    a ring reads at most 64 edges for each account that may still come. Beyond either the root is
    marked truncated and goes no further. `via` (from degree 2 on) names the predecessors of the ring before, the first 64
    in that order, sorted.

    Edges are evaluated once and stored. A root whose ring can't have more edges than accounts are left, as no account has more than the widest
    one, meets no limit: its edges are joined and gathered by root, and nothing is numbered or ranked that no later ring needs.
    For the other roots edges are stored with their place among their issuer's edges, so a ring's order (by issuer, subject) follows
    from running sums over its issuers, of which a root has at most `most`: no ring's edges are sorted, and of an issuer
    with very many edges only those that any ring could read take part. The last ring isn't stored.
    """
    if not 1 <= max_degree <= MOST_DEGREE:
        raise ValueError(f"degree must be 1 to {MOST_DEGREE}")
    folder = shared_dir(edges.sparkSession)
    edges = stored(edges.select("issuer", "subject").distinct(), f"{folder}/edges")
    degrees = edges.groupBy("issuer").agg(F.count(F.lit(1)).alias("out"))
    widest = degrees.agg(F.max("out")).first()[0] or 0
    placed, stops = None, None
    empty = F.expr("cast(array() as array<string>)")
    root = Window.partitionBy("root")
    start = roots.select(F.col("did").alias("root")).distinct()
    seen = start.select("root", F.col("root").alias("did"), F.lit(0).alias("degree"), empty.alias("via"))
    frontier = start.select("root", F.col("root").alias("issuer"), F.lit(1).alias("pos"), F.lit(most).cast("long").alias("left"), F.lit(1).cast("long").alias("ring"))
    for degree in range(1, max_degree + 1):
        roomy = (F.col("left") > 0) & (F.col("ring") * widest <= F.col("left"))
        steps = frontier.filter(roomy).join(edges, "issuer").select("root", "issuer", "pos", "left", "subject")
        narrow = frontier.filter(~roomy).drop("ring")
        limits = not narrow.isEmpty()
        if limits:
            if placed is None:
                placed = stored(placed_edges(edges, folder).drop("part").filter(F.col("nth") <= most * EDGES_PER_ACCOUNT), f"{folder}/placed")
            issuers = narrow.join(degrees, "issuer", "left").fillna(0, ["out"])
            issuers = issuers.withColumn("upto", F.sum("out").over(root.orderBy("issuer"))).withColumn("after", F.col("upto") - F.col("out")).withColumn("limit", F.col("left") * EDGES_PER_ACCOUNT)
            issuers = stored(issuers, f"{folder}/issuers-{degree}")
            readable = (placed["issuer"] == issuers["issuer"]) & (F.col("nth") <= F.col("limit") - F.col("after"))
            steps = steps.unionByName(issuers.filter("left > 0 and after < limit").join(placed, readable).select("root", issuers["issuer"], "pos", "left", "subject"))
            stopped = issuers.filter("left <= 0 or upto > limit").select("root")
        # What is known already is gathered with the steps, by root alone, so that a ring's rows move once.
        known = seen.select("root", F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("left"), F.col("did").alias("subject"))
        gathered = steps.filter("subject <> '' and subject <> root").unionByName(known).repartition("root").groupBy("root", "subject")
        values = [F.min("left").alias("left"), F.min("pos").alias("pos"), F.max(F.col("issuer").isNull()).alias("known")]
        if degree > 1:
            values.append(F.collect_list(F.when(F.col("issuer").isNotNull(), F.struct("pos", "issuer"))).alias("via"))
        fresh = gathered.agg(*values).filter("not known").drop("known")
        fresh = fresh.withColumn("via", F.array_sort(F.slice(F.array_sort("via")["issuer"], 1, via)) if degree > 1 else empty)
        if degree < max_degree or limits:
            fresh = fresh.withColumn("rank", F.row_number().over(root.orderBy("pos", "subject"))).withColumn("ring", F.count(F.lit(1)).over(root))
            fresh = stored(fresh, f"{folder}/ranked-{degree}")
        taken = fresh
        if limits:
            stopped = stopped.unionByName(fresh.filter("rank > left").select("root"))
            stops = (stopped if stops is None else stops.unionByName(stopped)).distinct()
            taken = fresh.filter("rank <= left")
        seen = seen.unionByName(taken.select("root", F.col("subject").alias("did"), F.lit(degree).alias("degree"), "via"))
        if degree < max_degree:
            frontier = taken.select("root", F.col("subject").alias("issuer"), F.col("rank").alias("pos"), (F.col("left") - F.col("ring")).alias("left"), "ring")
            frontier = frontier if stops is None else frontier.join(stops, "root", "left_anti")
    found = seen.filter("degree > 0")
    if stops is None:
        return found.withColumn("truncated", F.lit(False))
    return found.join(stops.withColumn("truncated", F.lit(True)), "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def closure_page(found: DataFrame, root: str, degree: int | None = None, first: int = 20, after: tuple[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows by degree and DID, total) of one root; `after` is the last row's (degree, did)."""
    rows = found.filter(F.col("root") == root)
    if degree is not None:
        rows = rows.filter(F.col("degree") == degree)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    if after is not None:
        rows = rows.filter((F.col("degree") > after[0]) | ((F.col("degree") == after[0]) & (F.col("did") > after[1])))
    return rows.orderBy("degree", "did").limit(first), total


def with_profiles(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Closure rows with the profile of the account and of each `via` account (null where there is none)."""
    found = stored(found, f"{shared_dir(found.sparkSession)}/found")  # read twice
    own = profiles.select("did", F.col("profile"))
    others = found.select("root", "did", F.explode("via").alias("v")).join(own.select(F.col("did").alias("v"), "profile"), "v", "left")
    lists = others.groupBy("root", "did").agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("did"), "profile"))).alias("via_profiles"))
    return found.join(own, "did", "left").join(lists, ["root", "did"], "left")


def home_timeline(records: DataFrame, follow_edges: DataFrame, collections: list[str], most: int = 50) -> DataFrame:
    """For every viewer the newest records of the authors they follow, at most `most` each.

    Of an author no more than their newest `most` records can show anywhere, so only those meet the followers.
    """
    scoped = records.filter(F.col("collection").isin(collections) & F.col("record_created_at").isNotNull())
    order = (F.col("record_created_at").desc(), F.col("uri").desc())
    newest = scoped.withColumn("place", F.row_number().over(Window.partitionBy("did").orderBy(*order))).filter(F.col("place") <= most).drop("place")
    shown = newest.join(follow_edges.select(F.col("did").alias("viewer"), F.col("subject").alias("did")), "did")
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("viewer").orderBy(*order))).filter(F.col("place") <= most)
