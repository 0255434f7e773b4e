"""Groups of touching instances, and how close they come to other structures compared with chance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import null_percentile
from voxelgrain.operators import groups
from voxelgrain.operators.measure import connected


def clusters(instances: DataFrame, contacts: DataFrame, strict: bool = False) -> DataFrame:
    """``object_id, entity, label, cluster`` of every instance: connected components under the contacts.

    Contacts never leave an object, so each object's components are found in one task, by whole arrays at a time. A cluster's
    name is its smallest member's ``entity:label``. Ends of contacts that aren't instances (masks, with a null
    label) are nodes too, unless ``strict``: then such contacts don't count.
    """
    kind = instances.schema["object_id"].dataType.simpleString()

    def union(table: pa.Table) -> pa.Table:
        objects, names = groups.codes(table.column("object_id"))
        begins = groups.starts(objects)
        group = groups.within(begins, len(objects))
        link = table.column("link").to_numpy()
        n = len(link)
        # Every end of a link, and every instance, is a row; ends of one name are one node.
        of = np.concatenate([group, group[link]])
        entities, entity_names = groups.codes(pa.concat_arrays([table.column("entity_a").combine_chunks(), table.column("entity_b").combine_chunks().filter(pa.array(link))]))
        labels = pa.concat_arrays([table.column("label_a").combine_chunks(), table.column("label_b").combine_chunks().filter(pa.array(link))])
        # Masks, which have no label, come before all labels.
        rank = groups.numbers(labels.fill_null(-1))
        order = np.lexsort((rank, entities, of))
        new = groups.starts(of[order], entities[order], rank[order])
        place = np.empty(len(order), np.int64)
        place[order] = groups.within(new, len(order))
        first = order[new]
        real = np.zeros(len(new), bool)
        real[place[:n][~link]] = True
        a, b = place[:n][link], place[n:]
        if strict:
            both = real[a] & real[b]
            a, b = a[both], b[both]
        root = connected(len(new), a, b)
        shown = np.flatnonzero(real) if strict else np.arange(len(new))
        entity = entity_names.take(pa.array(entities[first]))
        name = pc.binary_join_element_wise(entity, pa.array(rank[first]).cast(pa.string()), ":")
        ids = names.take(pa.array(objects[begins[of[first[shown]]]]))
        return pa.table([ids, entity.take(pa.array(shown)), labels.take(pa.array(first[shown])), name.take(pa.array(root[shown]))], ["object_id", "entity", "label", "cluster"])

    nodes = instances.select("object_id", F.lit(False).alias("link"), F.col("entity").alias("entity_a"), F.col("label").cast("long").alias("label_a"), F.lit(None).cast("string").alias("entity_b"), F.lit(None).cast("long").alias("label_b")).distinct()
    links = contacts.select("object_id", F.lit(True).alias("link"), "entity_a", F.col("label_a").cast("long").alias("label_a"), "entity_b", F.col("label_b").cast("long").alias("label_b"))
    return groups.by_group(nodes.unionByName(links), ("object_id",), union, f"object_id {kind}, entity string, label long, cluster string")


def per_object(members: DataFrame) -> DataFrame:
    """Clusters of two or more by object: their number, instances, largest, and those of several types."""
    by_cluster = members.groupBy("object_id", "cluster").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("types"))
    real = F.col("n") >= 2
    return by_cluster.groupBy("object_id").agg(
        F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("clustered"),
        F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("largest"), F.count_if(real & (F.col("types") > 1)).alias("mixed"),
    )


def object_metrics(profiles: DataFrame, contacts: DataFrame, members: DataFrame) -> DataFrame:
    """By object: the share of instances in contact, the mean number of partners, the largest cluster (null for none), and the median gap."""
    rows = profiles.groupBy("object_id").agg(
        F.try_divide(100.0 * F.count_if(F.col("partners") > 0), F.count("*")).alias("pct_in_contact"), F.avg("partners").alias("mean_partners"),
    )
    rows = rows.join(per_object(members).select("object_id", F.nullif("largest", F.lit(0)).alias("largest_cluster")), "object_id", "left")
    return rows.join(contacts.groupBy("object_id").agg(F.median("gap_um").alias("median_gap_um")), "object_id", "left")


def condition_totals(profiles: DataFrame, contacts: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums by condition of what is known by object."""
    objects = profiles.groupBy("object_id").agg(F.count("*").alias("instances"), F.count_if(F.col("partners") > 0).alias("in_contact"))
    touching = contacts.groupBy("object_id").agg(F.count("*").alias("contacts"))
    rows = groups.join(objects, "object_id").join(touching, "object_id", "left").join(per_object(members), "object_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = rows.groupBy("grp").agg(F.count("*").alias("objects"), *(total(c) for c in ("instances", "in_contact", "contacts", "clusters", "mixed")), F.max("largest").alias("largest"))
    return out.withColumn("pct_in_contact", F.try_divide(100.0 * F.col("in_contact"), F.col("instances")))


def cluster_reach(members: DataFrame, distances: DataFrame) -> DataFrame:
    """For each cluster of two or more and each target it isn't made of: size, observed least distance, and the pool it is compared with.

    The pool is every distance to the target of the instances of the cluster's types in its object, members
    included. ``beats`` is the percentage of equally large random groups that come less close; see ``null_percentile``.
    """
    known = distances.where(F.col("distance_um").isNotNull())
    groups = members.groupBy("object_id", "cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("entity")).alias("made")).where("size >= 2")
    own = members.join(groups, ["object_id", "cluster"]).join(known, ["object_id", "entity", "label"]).where(~F.array_contains("made", F.col("target")))
    observed = own.groupBy("object_id", "cluster", "size", "made", "target").agg(F.min("distance_um").alias("observed_um"))
    # Clusters that are made of the same types share a pool, so that is made once, and counted by value.
    pools = observed.select("object_id", "made", "target").distinct().withColumn("entity", F.explode("made")).join(known, ["object_id", "entity", "target"])
    by_value = pools.groupBy("object_id", "made", "target", "distance_um").agg(F.count("*").alias("times"))
    up_to = Window.partitionBy("object_id", "made", "target").orderBy("distance_um")
    whole = Window.partitionBy("object_id", "made", "target")
    by_value = by_value.select("*", F.sum("times").over(up_to).alias("upto"), F.sum("times").over(whole).alias("pool"))
    found = observed.join(by_value.withColumnRenamed("distance_um", "observed_um"), ["object_id", "made", "target", "observed_um"])
    beats = null_percentile(F.col("pool"), F.col("size"), F.col("upto") - F.col("times"), F.col("upto"))
    return found.select("object_id", "cluster", "target", "size", "pool", "observed_um", beats.alias("beats"))


def median_beats(reach: DataFrame) -> DataFrame:
    return reach.groupBy("target").agg(F.count("beats").alias("n"), F.median("beats").alias("median_beats"))
