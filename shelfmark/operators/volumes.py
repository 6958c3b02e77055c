"""Disks and shares: how they are shown, which catalogued volume a detected one is, what came and went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold, normal_unc, unc_server, unc_share

#: Buses of disks outside the machine.
EXTERNAL = ["usb", "ieee1394", "sd", "mmc"]


def display_kind(kind: Column, bus: Column) -> Column:
    """network, stick, external or internal."""
    return F.when(kind == "network", "network").when(kind == "removable", "stick").when(F.lower(bus).isin(EXTERNAL), "external").otherwise("internal")


def display_name() -> Column:
    """The user's name, else the label, else the mount, else the number; blank is none."""
    some = lambda n: F.nullif(F.trim(n), F.lit(""))
    return F.coalesce(some("user_name"), some("os_label"), some("last_mount"), F.concat(F.lit("#"), F.col("id").cast("string")))


def used_percent() -> Column:
    ok = (F.col("capacity") > 0) & F.col("free_space").isNotNull()
    return F.when(ok, F.floor((F.col("capacity") - F.col("free_space")) * 100 / F.col("capacity")).cast("long"))


#: States in which a volume is kept up to date on its own; files read at the same time from a share.
AUTO_UPDATE = ["indexed", "reindex_needed"]
NETWORK_READERS = 4


def section() -> Column:
    """Where a volume stands in the catalog: online, network (whether its server answers or not) or offline."""
    return F.when(F.col("kind") == "network", "network").when(F.col("online"), "online").otherwise("offline")


def visible(volumes: DataFrame) -> DataFrame:
    """All volumes but the ignored ones; an unknown status is shown."""
    return volumes.where(F.coalesce(F.col("status") != "ignored", F.lit(True)))


def filter_counts(volumes: DataFrame) -> DataFrame:
    """How many volumes each filter shows: one row of all_volumes, online, network, offline."""
    n = lambda s: F.count_if(section() == s).alias(s)
    return visible(volumes).agg(F.count("*").alias("all_volumes"), n("online"), n("network"), n("offline"))


def cards_order(volumes: DataFrame) -> list[Column]:
    """Connected disks first, then shares, then the others; by name, then id."""
    return [F.when(section() == "online", 0).when(section() == "network", 1).otherwise(2), fold(display_name()), F.col("id")]


def updated_by() -> tuple[Column, Column]:
    """Whether a connected volume is kept up to date by its journal (local, NTFS), and whether by watching its folders."""
    ntfs = F.coalesce(F.upper("fs_type") == "NTFS", F.lit(False))
    auto = F.coalesce(F.col("status").isin(AUTO_UPDATE), F.lit(False))
    network = F.coalesce(F.col("kind") == "network", F.lit(False))
    on = F.coalesce("online", F.lit(False))
    return on & auto & ~network & ntfs, on & (auto | F.coalesce(F.col("status") == "indexing", F.lit(False))) & (network | ~ntfs)


def readers() -> Column:
    return F.when(F.col("kind") == "network", NETWORK_READERS).otherwise(1).cast("long")


def resource() -> Column:
    """What a job on the volume keeps busy: the server of a share, the disk of anything else; null if unknown."""
    return F.when(F.col("kind") == "network", F.concat(F.lit("net:"), F.coalesce(unc_server(F.col("unc_path")), F.lit("")))).otherwise(F.concat(F.lit("disk:"), "disk_key"))


def dimensions(volumes: DataFrame) -> DataFrame:
    """`what, key, value`: the disk of each volume, the medium of each disk, the shares of each server that isn't ignored."""
    disks = volumes.where("disk_key IS NOT NULL").select(F.lit("volume_disk").alias("what"), F.col("id").cast("string").alias("key"), F.col("disk_key").alias("value"))
    media = volumes.where("disk_key IS NOT NULL").groupBy("disk_key").agg(F.max("bus_type").alias("value")).select(F.lit("disk_medium").alias("what"), F.col("disk_key").alias("key"), "value")
    servers = visible(volumes).where("kind = 'network' AND unc_path IS NOT NULL").groupBy(unc_server(F.col("unc_path")).alias("key")).agg(F.count("*").cast("string").alias("value"))
    return disks.unionByName(media).unionByName(servers.select(F.lit("server_shares").alias("what"), "key", "value"))


def resolve(choice: DataFrame, chosen: int | None, det: int) -> tuple[str, int | None]:
    """What becomes of an ambiguous volume: ("known", id) for one of its candidates, ("new", None) for none; anything else is refused."""
    ids = {r["volume_id"] for r in choice.where(F.col("det") == det).select("volume_id").collect()}  # a handful of disks
    if not ids or (chosen is not None and chosen not in ids):
        raise ValueError(f"{chosen} is no candidate of {det}")
    return ("new", None) if chosen is None else ("known", chosen)


def group_key() -> Column:
    """Volumes of one disk or one server belong together."""
    return F.when(F.col("disk_key").isNotNull(), F.concat(F.lit("disk:"), "disk_key")).when(F.col("unc_path").isNotNull(), F.concat(F.lit("net:"), unc_server(F.col("unc_path")))).otherwise(F.concat(F.lit("volume:"), F.col("id").cast("string")))


def cards(volumes: DataFrame, root_totals: DataFrame) -> DataFrame:
    """One row per volume for the overview; `root_totals`: volume_id, total_size, file_count."""
    t = root_totals.select(F.col("volume_id").alias("id"), F.col("total_size").alias("size"), F.col("file_count").alias("files"))
    return volumes.join(t, "id", "left").select("id", display_name().alias("name"), display_kind(F.col("kind"), F.col("bus_type")).alias("shown_as"), used_percent().alias("used_percent"), group_key().alias("group_key"), "status", "online", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("files", F.lit(0)).alias("files"))


def candidates(detected: DataFrame, known: DataFrame) -> DataFrame:
    """`det, id, guid, capacity_ok`: catalogued volumes with the identity of a detected one.

    A share is known by its path; a disk by serial number and file system, without a serial by its volume GUID.
    """
    d = detected.select(F.col("id").alias("det"), (F.col("kind") == "network").alias("net"), normal_unc(F.col("unc_path")).alias("u"), "fs_serial", fold(F.col("fs_type")).alias("fs"), fold(F.col("volume_guid")).alias("g"), F.col("capacity").alias("cap"))
    k = known.select("id", (F.col("kind") == "network").alias("net"), normal_unc(F.col("unc_path")).alias("u"), "fs_serial", fold(F.col("fs_type")).alias("fs"), fold(F.col("volume_guid")).alias("kg"), F.col("capacity").alias("kcap"))
    kk = k.select("id", "kg", "kcap", *[F.col(c).alias(f"k_{c}") for c in ("net", "u", "fs_serial", "fs")])
    take = lambda j: j.select("det", "id", (F.coalesce(F.col("g") == F.col("kg"), F.lit(False))).alias("guid"), (F.col("cap").isNull() | F.coalesce(F.col("cap") == F.col("kcap"), F.lit(False))).alias("capacity_ok"), "net")
    nets = take(d.where("net").join(kk.where("k_net"), F.col("u") == F.col("k_u")))
    serial = take(d.where("NOT net AND fs_serial IS NOT NULL").join(kk.where("NOT k_net"), (F.col("fs_serial") == F.col("k_fs_serial")) & (F.col("fs") == F.col("k_fs"))))
    guid = take(d.where("NOT net AND fs_serial IS NULL").join(kk.where("NOT k_net"), F.col("g") == F.col("kg")))
    return nets.unionByName(serial).unionByName(guid)


def decided(detected: DataFrame, known: DataFrame) -> dict[int, tuple[str, int | None, list[int]]]:
    """Per detected id: known (with the volume's id), new, or ambiguous (with the candidates among which the user chooses).

    One volume with the same GUID, or else one of the same capacity, is the one; volumes confirmed by GUID are given
    away first, each only once, in the order of detected ids. A share at an unknown address may be a share of that name
    on another server that isn't connected. Detected and known volumes are a handful of disks, so the giving away runs
    on the driver over their candidates.
    """
    by: dict[int, list] = {r["id"]: [] for r in detected.select("id").orderBy("id").collect()}
    for r in candidates(detected, known).collect():
        by[r["det"]].append(r)
    done: dict[int, tuple[str, int | None, list[int]]] = {}
    taken: set[int] = set()
    for strong in (True, False):
        for det, all_ in by.items():
            if det in done:
                continue
            c = [r for r in all_ if r["id"] not in taken]
            same = [r for r in c if r["guid"] and not r["net"]]
            if len(same) != 1:
                same = [r for r in c if r["capacity_ok"]] if c and not c[0]["net"] else c
            verdict = ("new", None, []) if not c else ("known", same[0]["id"], []) if len(same) == 1 else ("ambiguous", None, sorted(r["id"] for r in same or c))
            if strong and not (verdict[0] == "known" and same[0]["guid"]):
                continue
            if verdict[0] == "known":
                taken.add(verdict[1])
            done[det] = verdict
    moved: dict[int, list[int]] = {}
    shares = known.where("kind = 'network'")
    if "status" in known.columns:
        shares = shares.where("status IS DISTINCT FROM 'ignored'")
    for r in moved_shares(detected.where("kind = 'network'"), shares).collect():
        if r["id"] not in taken and done[r["det"]][0] == "new":
            moved.setdefault(r["det"], []).append(r["id"])
    return done | {det: ("ambiguous", None, sorted(ids)) for det, ids in moved.items()}


def match(detected: DataFrame, known: DataFrame) -> DataFrame:
    """`det, decision, id`: known (with the volume's id), new, or ambiguous (ids null)."""
    return detected.sparkSession.createDataFrame([(d, v, i) for d, (v, i, _) in decided(detected, known).items()], "det long, decision string, id long")


def ambiguous(detected: DataFrame, known: DataFrame) -> DataFrame:
    """One row per candidate of each ambiguous detected volume, as shown for the choice: det, volume_id, name, location, mount, path, capacity."""
    rows = [(d, i) for d, (_, _, ids) in decided(detected, known).items() for i in ids]
    choice = detected.sparkSession.createDataFrame(rows, "det long, id long")
    location = F.when(F.trim("location") != "", F.col("location")).alias("location")
    return choice.join(known, "id").select("det", F.col("id").alias("volume_id"), display_name().alias("name"), location, F.col("last_mount").alias("mount"), F.col("unc_path").alias("path"), "capacity")


def moved_shares(detected: DataFrame, known: DataFrame) -> DataFrame:
    """`det, id`: for a share at an unknown address, the catalogued shares of that name on other servers."""
    d = detected.where("unc_path IS NOT NULL").select(F.col("id").alias("det"), unc_server(F.col("unc_path")).alias("ds"), unc_share(F.col("unc_path")).alias("share"))
    k = known.where("unc_path IS NOT NULL").select("id", unc_server(F.col("unc_path")).alias("ks"), unc_share(F.col("unc_path")).alias("share"))
    return d.join(k, "share").where("ds <> ks").select("det", "id")


def unmapped_shares(known: DataFrame, mapped: DataFrame) -> DataFrame:
    """Catalogued shares that no mapped path shows."""
    k = known.where("unc_path IS NOT NULL").withColumn("u", normal_unc(F.col("unc_path")))
    return k.join(mapped.select(normal_unc(F.col("unc_path")).alias("u")), "u", "left_anti").drop("u")


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """`id, change`: came, left, moved (another mount) or same, of two detections (id, mount)."""
    j = before.select("id", F.col("mount").alias("m0"), F.lit(True).alias("b")).join(now.select("id", F.col("mount").alias("m1"), F.lit(True).alias("n")), "id", "full_outer")
    return j.select("id", F.when(F.col("b").isNull(), "came").when(F.col("n").isNull(), "left").when(~F.col("m0").eqNullSafe(F.col("m1")), "moved").otherwise("same").alias("change"))


def share_check(known_names: DataFrame, found_names: DataFrame) -> DataFrame:
    """Per volume: names at its top in the catalog, and how many of them a listing of the new path has (any case)."""
    k = known_names.select("volume_id", fold(F.col("name")).alias("n")).distinct()
    f = found_names.select("volume_id", fold(F.col("name")).alias("n")).distinct().withColumn("hit", F.lit(True))
    return k.join(f, ["volume_id", "n"], "left").groupBy("volume_id").agg(F.count("*").alias("known"), F.count("hit").alias("found"))


def changed_rows(before: DataFrame, now: DataFrame, id: str = "id") -> DataFrame:
    """`id, change`: added, removed, changed or same rows of two versions of a view, by a digest of all columns."""
    cols = [c for c in before.columns if c != id]
    digest = F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])
    j = before.select(id, digest.alias("d0")).join(now.select(id, digest.alias("d1")), id, "full_outer")
    return j.select(id, F.when(F.col("d0").isNull(), "added").when(F.col("d1").isNull(), "removed").when(F.col("d0") != F.col("d1"), "changed").otherwise("same").alias("change"))


def known_locations(volumes: DataFrame) -> DataFrame:
    """Distinct locations in any case, in the spelling of the least volume id, with their number of volumes."""
    v = volumes.where(F.trim("location") != "")
    return v.groupBy(fold(F.trim("location")).alias("k")).agg(F.min_by("location", "id").alias("location"), F.count("*").alias("volumes")).drop("k")
