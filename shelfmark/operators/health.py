"""Disk health: decoding pages, worsening, thinning of the history, states of network storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in their order; degrees from which a disk is hot; milliseconds of a day.
SEVERITY = ["unknown", "good", "warning", "critical"]
HOT = 65
DAY_MS = 86_400_000


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.lower(status)), F.lit(0))


def _le(page: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number of n bytes at an offset from 0 (the low 8 bytes of longer ones)."""
    bytes_ = F.concat(*[F.hex(F.substring(page, at + i + 1, 1)) for i in reversed(range(n))])
    return F.conv(bytes_, 16, 10).cast("long")


def _flagged(flags: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """Status and distinct reasons (in order) of the flags that are up."""
    reasons = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(r)) for c, _, r in flags]), lambda x: x.isNotNull()))
    worst = F.greatest(F.lit(1), *[F.when(c, SEVERITY.index(s)).otherwise(0) for c, s, _ in flags])
    return F.element_at(F.array(*map(F.lit, SEVERITY)), (worst + 1).cast("int")), reasons


def nvme_reading(page: Column) -> Column:
    """A struct of an NVMe health page (null below 192 bytes): status, reasons, temperature, hours, wear, media_errors, spare."""
    warn, kelvin, spare, least, used = (_le(page, a, n) for a, n in ((0, 1), (1, 2), (3, 1), (4, 1), (5, 1)))
    degrees = F.when(kelvin > 0, kelvin - 273)
    errors = _le(page, 160, 8)
    status, reasons = _flagged([
        ((warn.bitwiseAND(0b11101) != 0) | ((least > 0) & (spare < least)), "critical", "nvme_critical_warning"),
        (warn.bitwiseAND(0b10) != 0, "warning", "temperature"),
        (used >= 100, "critical", "worn_out"),
        ((used >= 90) & (used < 100), "warning", "wear_high"),
        (errors > 0, "warning", "media_errors"),
        (degrees >= HOT, "warning", "temperature"),
    ])
    r = F.struct(status.alias("status"), reasons.alias("reasons"), degrees.alias("temperature"), _le(page, 128, 8).alias("hours"), used.alias("wear"), errors.alias("media_errors"), spare.alias("spare"))
    return F.when(F.octet_length(page) >= 192, r)


def ata_attributes(values: Column, thresholds: Column) -> Column:
    """Array of (id, current, worst, raw, threshold) of the 30 places of an ATA page; empty places are left out."""
    byte = lambda p, at: F.conv(F.hex(F.substring(p, at + 1, 1)), 16, 10).cast("long")
    slots = F.sequence(F.lit(0), F.lit(29))
    limits = F.filter(F.transform(slots, lambda i: F.struct(byte(thresholds, 2 + i * 12).alias("id"), byte(thresholds, 3 + i * 12).alias("t"))), lambda x: x["id"] > 0)

    def slot(i):
        at = 2 + i * 12
        raw = sum((byte(values, at + 5 + k) * (1 << 8 * k) for k in range(1, 6)), byte(values, at + 5))
        id_ = byte(values, at)
        limit = F.coalesce(F.get(F.filter(limits, lambda x: x["id"] == id_), F.lit(0))["t"], F.lit(0).cast("long"))
        return F.struct(id_.alias("id"), byte(values, at + 3).alias("current"), byte(values, at + 4).alias("worst"), raw.alias("raw"), limit.alias("threshold"))

    return F.filter(F.transform(slots, slot), lambda x: x["id"] > 0)


def ata_reading(attrs: Column, failing: Column) -> Column:
    """A struct: status, reasons, temperature, hours, reallocated, pending, wear."""
    get = lambda i: F.get(F.filter(attrs, lambda a: a["id"] == i), F.lit(0))
    raw = F.coalesce(get(194)["raw"], get(190)["raw"]) % 256
    degrees = F.when((raw > 0) & (raw < 120), raw)
    life = F.coalesce(*[get(i)["current"] for i in (231, 233, 177, 202)])
    wear = F.greatest(F.lit(100) - life, F.lit(0)).cast("long")
    moved, pending = get(5)["raw"], get(197)["raw"]
    status, reasons = _flagged([
        (failing, "critical", "smart_failing"),
        (F.exists(attrs, lambda a: (a["threshold"] > 0) & (a["current"] <= a["threshold"])), "critical", "attribute_failed"),
        (moved > 0, "warning", "reallocated"),
        (F.coalesce(pending > 0, F.lit(False)) | F.coalesce(get(198)["raw"] > 0, F.lit(False)), "warning", "pending"),
        (F.coalesce(wear >= 90, F.lit(False)), "warning", "wear_high"),
        (degrees >= HOT, "warning", "temperature"),
    ])
    return F.struct(status.alias("status"), reasons.alias("reasons"), degrees.alias("temperature"), (get(9)["raw"] % (1 << 32)).alias("hours"), moved.alias("reallocated"), pending.alias("pending"), wear.alias("wear"))


def worsening(readings: DataFrame, key: str = "disk_key", order: tuple[str, ...] = ("at_ms", "reading_no"), counters: tuple[str, ...] = ("reallocated",)) -> DataFrame:
    """Readings that are worse than the one before, and why: status first, then the counters in order. A first reading alarms only if critical."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct("status", *counters)).over(w)
    df = readings.withColumn("_b", before)
    b = F.col("_b")
    why = F.when(b.isNull(), F.when(F.lower("status") == "critical", "status")).when((severity(b["status"]) > 0) & (severity(F.col("status")) > severity(b["status"])), "status")
    for c in counters:
        why = why.when(F.col(c) > b[c], c)
    return df.withColumn("reason", why).where("reason IS NOT NULL").drop("_b")


def thinned(readings: DataFrame, key: str = "disk_key", at: str = "at_ms", tie: str = "reading_no", significant: tuple[str, ...] = ("status", "reallocated"), gap_ms: int = DAY_MS) -> DataFrame:
    """The readings a history keeps: those that differ in what is significant from the last kept one, or a day or more after it.

    Every reading that differs from the one just before it is kept whatever came earlier (between equal readings the
    kept one is equal too), so those readings cut a disk's history into runs of equal readings. Within a run only time
    decides; a run is folded over its times, one number each.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    state = F.struct(*significant)
    df = readings.withColumn("_new", ~state.eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1))
    df = df.withColumn("_run", F.sum(F.col("_new").cast("long")).over(w))
    times = df.groupBy(key, "_run").agg(F.array_sort(F.collect_set(at)).alias("ts"))
    kept = F.aggregate("ts", F.array(F.element_at("ts", 1)), lambda acc, t: F.when(t - F.element_at(acc, -1) >= gap_ms, F.concat(acc, F.array(t))).otherwise(acc))
    keep = times.select(key, "_run", F.explode(kept).alias(at))
    first = df.join(keep, [key, "_run", at], "left_semi").groupBy(key, "_run", at).agg(F.min_by(F.struct(*readings.columns), tie).alias("r"))
    return first.select("r.*")


def latest(readings: DataFrame, n: int, key: str = "disk_key", order: tuple[str, ...] = ("at_ms", "reading_no")) -> DataFrame:
    """The newest `n` readings of each disk, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return readings.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= n)


#: Schemas of the two answers of a network storage.
RAID_SCHEMA = "data array<struct<name: string, mount: string, raid_level: string, status: string, activity: string, size: bigint, disks: array<string>>>"
DISK_SCHEMA = "data array<struct<serial: string, model: string, healthy: boolean, faulty: boolean, temperature: int>>"


def nas_disks(answers: DataFrame) -> DataFrame:
    """`server, storage, raid_status, activity, serial, healthy, faulty, missing` from the JSON of both answers; disks an array names but the machine doesn't list are missing."""
    r = answers.select("server", F.explode(F.from_json("raid_json", RAID_SCHEMA)["data"]).alias("s"))
    named = r.select("server", F.col("s.name").alias("storage"), F.col("s.status").alias("raid_status"), F.col("s.activity").alias("activity"), F.explode_outer("s.disks").alias("serial"))
    d = answers.select("server", F.explode(F.from_json("disk_json", DISK_SCHEMA)["data"]).alias("d")).select("server", "d.serial", "d.healthy", "d.faulty")
    j = named.join(d, ["server", "serial"], "left")
    return j.select("server", "storage", "raid_status", "activity", "serial", F.coalesce("healthy", F.lit(True)).alias("healthy"), F.coalesce("faulty", F.lit(False)).alias("faulty"), (F.col("serial").isNotNull() & F.col("healthy").isNull()).alias("missing"))


def nas_states(disks: DataFrame) -> DataFrame:
    """`server, storage, state`: ok, attention or problem."""
    c = F.col
    bad = F.coalesce(F.lower("raid_status") != "ok", F.lit(False)) | c("faulty") | c("missing")
    soso = ~c("healthy") | F.coalesce(F.lower("activity") != "idle", F.lit(False))
    rank = F.max(F.when(bad, 2).when(soso, 1).otherwise(0))
    return disks.groupBy("server", "storage").agg(rank.alias("r")).select("server", "storage", F.when(c("r") == 2, "problem").when(c("r") == 1, "attention").otherwise("ok").alias("state"))


def nas_problems(disks: DataFrame) -> DataFrame:
    """`server, problem` as stable keys, to tell news from what was known."""
    raid = disks.where(F.lower("raid_status") != "ok").select("server", F.concat_ws("|", F.lit("raid"), "storage", F.lower("raid_status")).alias("problem"))
    what = F.when(F.col("missing"), "missing").when(F.col("faulty"), "faulty").when(~F.col("healthy"), "unhealthy")
    return raid.unionByName(disks.where("serial IS NOT NULL").select("server", F.concat(F.lit("disk|"), "serial", F.lit("|"), what).alias("problem")).where("problem IS NOT NULL")).distinct()


def news(before: DataFrame, now: DataFrame) -> DataFrame:
    return now.join(before, ["server", "problem"], "left_anti")


def health_view(readings: DataFrame, media: DataFrame, n: int = 30) -> DataFrame:
    """`disk_key, points, status, most, medium`: the newest status of each disk, its last `n` readings in sum, and its saved medium (disk_key, medium)."""
    g = latest(readings, n).groupBy("disk_key").agg(F.count("*").alias("points"), F.max_by("status", F.struct("at_ms", "reading_no")).alias("status"), F.max("reallocated").alias("most"))
    return g.join(media.groupBy("disk_key").agg(F.max("medium").alias("medium")), "disk_key", "left")


#: The share that stands for the system's own storage, and where that is mounted.
SYSTEM_SHARE, SYSTEM_MOUNT = "ZIMAOS-HD", "/DATA"


def share_storages(shares: DataFrame, storages: DataFrame, disks: DataFrame) -> DataFrame:
    """`server, share, storage, n_disks, n_bad`: the storage a share shows (by name in any case, else the system's own), and its disks.

    shares: server, share. storages: server, storage, mount. disks: server, storage, serial, healthy, missing. Shares
    without a storage have nulls.
    """
    up = F.upper
    by_name = storages.groupBy("server", up("storage").alias("_k")).agg(F.min("storage").alias("_named"))
    system = storages.where(F.col("mount") == SYSTEM_MOUNT).groupBy("server").agg(F.min("storage").alias("_system"))
    j = shares.select("server", "share", up("share").alias("_k")).join(by_name, ["server", "_k"], "left").join(system, "server", "left")
    j = j.select("server", "share", F.coalesce("_named", F.when(F.col("_k") == SYSTEM_SHARE, F.col("_system"))).alias("storage"))
    d = disks.groupBy("server", "storage").agg(F.count("*").alias("n_disks"), F.count_if(F.col("missing") | ~F.col("healthy")).alias("n_bad"))
    return j.join(d, ["server", "storage"], "left").select("server", "share", "storage", "n_disks", "n_bad")
