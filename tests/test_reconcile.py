"""The reconciler on small trees, one volume each, so that one run serves many cases."""

import random

import pytest

from shelfmark.operators import reconcile as R

CAT = "volume_id long, id long, parent_id long, name string, is_dir boolean, file_ref long, size long, modified long"
LIST = "volume_id long, node long, parent_node long, name string, is_dir boolean, file_ref long, size long, modified long, state string, target long, extra string"


class Disk:
    """A tree of (ref -> name, parent ref, is_dir, size), root 0."""

    def __init__(self, rnd=None):
        self.rnd, self.files, self.next = rnd, {}, 1

    def add(self, parent, name, is_dir=False, size=1):
        r, self.next = self.next, self.next + 1
        self.files[r] = [name, parent, is_dir, size]
        return r

    def under(self, r):
        out = {r}
        while True:
            more = {k for k, v in self.files.items() if v[1] in out} - out
            if not more:
                return out
            out |= more

    def free(self, parent, name):
        return all((v[1], v[0]) != (parent, name) for v in self.files.values())

    def grow(self, n):
        for _ in range(n):
            p = self.rnd.choice([0, *[k for k, v in self.files.items() if v[2]]])
            name = self.rnd.choice("abcdefghij") + self.rnd.choice(["", "1", "2"])
            if self.free(p, name):
                self.add(p, name, self.rnd.random() < 0.4, self.rnd.randrange(5))

    def mutate(self, n):
        for _ in range(n):
            if not self.files:
                return
            r = self.rnd.choice(list(self.files))
            what = self.rnd.random()
            if what < 0.25:
                for k in self.under(r):
                    del self.files[k]
            elif what < 0.4:
                self.files[r][3] += 1
            elif what < 0.5:
                self.grow(1)
            else:
                p = self.rnd.choice([self.files[r][1], 0, *[k for k, v in self.files.items() if v[2]]])
                name = self.rnd.choice([self.files[r][0], self.rnd.choice("abcxyz")])
                if p not in self.under(r) and self.free(p, name):
                    self.files[r][0], self.files[r][1] = name, p

    def catalog(self, v, refs=True):
        at = lambda r: v * 10_000 + r
        return [(v, at(0), None, "", True, None, 0, 0)] + [(v, at(r), at(p), n, d, r if refs else None, 0 if d else s, 5) for r, (n, p, d, s) in self.files.items()]

    def listing(self, v, refs=True, shuffle=None, states=None):
        order = list(self.files)
        (shuffle or random.Random(v)).shuffle(order)
        node = {0: v * 10_000_000} | {r: v * 10_000_000 + k + 1 for k, r in enumerate(order)}
        states = states or {}
        return node, [(v, node[0], None, "", True, None, 0, 0, states.get(0), None, "x")] + [(v, node[r], node[p], n, d, r if refs else None, 0 if d else s, 5, states.get(r), None, "y") for r, (n, p, d, s) in self.files.items()]


def paths(rows):
    by = {r[1]: r for r in rows}
    out = set()
    for r in rows:
        names, at = [], r
        while at[2] is not None:
            names.append(at[3])
            at = by[at[2]]
        out.add((r[0], "\\".join(reversed(names)), r[4], r[6], r[7]))
    return out


def run(spark, old, new, candidates=None):
    cat, lst = spark.createDataFrame(old, CAT), spark.createDataFrame(new, LIST)
    cand = spark.createDataFrame([(i,) for i in candidates], "id long") if candidates else None
    ops = R.reconcile(cat, lst, cand)
    got = [tuple(r) for r in ops.collect()]
    after = [tuple(r) for r in R.apply_reconciled(cat, lst, ops).select("volume_id", "id", "parent_id", "name", "is_dir", "file_ref", "size", "modified").collect()]
    return {(o[0], o[1], o[2], o[3]) for o in got}, after


def test_update_equals_full_index(spark):
    """Random trees and changes: the catalog after the ops has the listing's paths, and every file with a reference keeps its entry."""
    old, new, want, same = [], [], set(), 0
    for v in range(1, 25):
        refs = v % 4 != 0
        d = Disk(random.Random(v))
        d.grow(25)
        old += d.catalog(v, refs)
        was = set(d.files)
        d.mutate(random.Random(v).randrange(1, 14))
        node, rows = d.listing(v, refs)
        new += rows
        want |= paths(rows)
        same += len(was & set(d.files)) if refs else 0
    ops, after = run(spark, old, new)
    assert paths(after) == want
    by_id = {r[1]: r for r in after}
    assert len(by_id) == len(after) and all(r[2] is None or by_id[r[2]][4] for r in after)
    kept = [r for r in after if r[5] is not None and r[1] % 10_000 == r[5] and r[1] < 1_000_000]
    assert len(kept) == same


@pytest.fixture(scope="module")
def cases(spark):
    old, new, at = [], [], {}

    def case(name, build, change, refs=True, states=None):
        v = 101 + len(at)
        d = Disk()
        r = build(d)
        old.extend(d.catalog(v, refs))
        change(d, r)
        node, rows = d.listing(v, refs, states=states(r) if states else None)
        new.extend(rows)
        at[name] = (v, r, node)

    def photos(d):
        p = d.add(0, "Photos", True)
        y = d.add(p, "2024", True)
        return p, y, d.add(y, "img.jpg", size=5), d.add(0, "Archive", True)

    def put(d, r, name=None, parent=None):
        d.files[r] = [name or d.files[r][0], d.files[r][1] if parent is None else parent, *d.files[r][2:]]

    case("moved folder", photos, lambda d, r: put(d, r[0], "Old Photos", r[3]))
    case("renamed folder", photos, lambda d, r: put(d, r[0], "P"))
    case("renamed, no refs", photos, lambda d, r: put(d, r[1], "2025"), refs=False)
    case("swap", lambda d: (d.add(0, "a.txt"), d.add(0, "b.txt", size=2)), lambda d, r: (put(d, r[0], "b.txt"), put(d, r[1], "a.txt")))
    case("under its child", lambda d: (x := d.add(0, "X", True), d.add(x, "B", True), d.add(x, "g")), lambda d, r: (put(d, r[1], parent=0), put(d, r[0], parent=r[1])))
    case("file to folder", lambda d: (d.add(0, "data"),), lambda d, r: (d.files.pop(r[0]), d.add(d.add(0, "data", True), "inside")))
    case("unreadable", lambda d: (p := d.add(0, "private", True), d.add(p, "secret")), lambda d, r: (d.files.pop(r[1]), d.add(0, "new")), states=lambda r: {r[0]: "incomplete"})
    case("not listed", lambda d: (p := d.add(0, "p", True), q := d.add(p, "q", True), d.add(q, "deep")), lambda d, r: (d.files.pop(r[2]), d.files.pop(r[1])), states=lambda r: {r[0]: "not_listed"})
    case("gone folder", photos, lambda d, r: [d.files.pop(x) for x in (r[0], r[1], r[2])])
    case("gone folder, one saved", photos, lambda d, r: (put(d, r[2], parent=0), d.files.pop(r[0]), d.files.pop(r[1])))
    ops, after = run(spark, old, new)
    return {n: ({(o[0], o[2] and o[2] - v * 10_000, o[3] and {x: k for k, x in node.items()}[o[3]]) for o in ops if o[1] == v and o[0] != "unchanged"}, paths([x for x in after if x[0] == v]), r) for n, (v, r, node) in at.items()}


def test_folders_keep_what_is_below(cases):
    for name in ("moved folder", "renamed folder"):
        ops, p, r = cases[name]
        assert ops == {("move", r[0], r[0])}, name
    assert "Archive\\Old Photos\\2024\\img.jpg" in {x[1] for x in cases["moved folder"][1]}


def test_without_references_names_decide(cases):
    ops, p, r = cases["renamed, no refs"]
    assert ops == {("insert", None, r[1]), ("insert", None, r[2]), ("delete", r[1], None)}  # the folder goes with what is below it


def test_swapped_names_follow_references(cases):
    ops, p, r = cases["swap"]
    assert ops == {("move", r[0], r[0]), ("move", r[1], r[1])} and {(x[1], x[3]) for x in p} >= {("a.txt", 2), ("b.txt", 1)}


def test_folder_under_its_former_child(cases):
    assert {x[1] for x in cases["under its child"][1]} == {"", "B", "B\\X", "B\\X\\g"}


def test_kinds_must_agree(cases):
    ops, p, r = cases["file to folder"]
    assert {o[0] for o in ops} == {"insert", "delete"} and {(x[1], x[2]) for x in p} == {("", True), ("data", True), ("data\\inside", False)}


def test_what_was_not_read_stays(cases):
    ops, p, r = cases["unreadable"]
    assert {o[0] for o in ops} == {"insert"} and {x[1] for x in p} == {"", "private", "private\\secret", "new"}
    ops, p, r = cases["not listed"]
    assert not ops and {x[1] for x in p} == {"", "p", "p\\q", "p\\q\\deep"}


def test_deletes_name_the_top(cases):
    ops, p, r = cases["gone folder"]
    assert ops == {("delete", r[0], None)} and {x[1] for x in p} == {"", "Archive"}
    ops, p, r = cases["gone folder, one saved"]
    assert ops == {("delete", r[0], None), ("move", r[2], r[2])} and {x[1] for x in p} == {"", "Archive", "img.jpg"}


def test_hard_links_keep_their_names(spark):
    old = [(1, 1, None, "", True, None, 0, 0), (1, 2, 1, "git", False, 7, 1, 1), (1, 3, 1, "git-a", False, 7, 1, 1), (1, 4, 1, "git-b", False, 7, 1, 1)]
    new = [(1, 91, None, "", True, None, 0, 0, None, None, ""), (1, 92, 91, "git-b", False, 7, 1, 1, None, None, ""), (1, 93, 91, "git", False, 7, 1, 1, None, None, ""), (1, 94, 91, "git-z", False, 7, 1, 1, None, None, "")]
    ops, after = run(spark, old, new)
    assert ops == {("unchanged", 1, 1, 91), ("unchanged", 1, 4, 92), ("unchanged", 1, 2, 93), ("move", 1, 3, 94)}


def test_contradicting_names_below_each_other(spark):
    """A folder whose reference contradicts is another folder, and so are those of the same names below it."""
    old = [(1, 1, None, "", True, None, 0, 0), (1, 2, 1, "d", True, 5, 0, 0), (1, 3, 2, "e", True, None, 0, 0), (1, 4, 3, "f", False, None, 1, 1), (1, 6, 1, "k", True, None, 0, 0), (1, 7, 6, "l", True, None, 0, 0)]
    new = [(1, 91, None, "", True, None, 0, 0, None, None, ""), (1, 92, 91, "d", True, 6, 0, 0, None, None, ""), (1, 93, 92, "e", True, None, 0, 0, None, None, ""), (1, 94, 93, "f", False, None, 1, 1, None, None, ""), (1, 96, 91, "k", True, 8, 0, 0, None, None, ""), (1, 97, 96, "l", True, None, 0, 0, None, None, "")]
    ops, after = run(spark, old, new)
    assert ops == {("unchanged", 1, 1, 91), ("insert", 1, None, 92), ("insert", 1, None, 93), ("insert", 1, None, 94), ("delete", 1, 2, None), ("unchanged", 1, 6, 96), ("unchanged", 1, 7, 97)}


def test_several_targets_and_candidates(spark):
    d = Disk()
    a, b = d.add(0, "a", True), d.add(0, "b", True)
    x, y, z = d.add(a, "x"), d.add(a, "y"), d.add(a, "z")
    old = d.catalog(1)
    # only folders a and b were listed: x has moved to b, y (asked for) is gone, z was not looked at
    new = [(1, 901, None, "a", True, a, 0, 5, "partial", 10_000 + a, ""), (1, 902, None, "b", True, b, 0, 5, "partial", 10_000 + b, ""), (1, 903, 902, "x", False, x, 1, 5, None, None, "")]
    ops, after = run(spark, old, new, [10_000 + x, 10_000 + y])
    assert {o for o in ops if o[0] != "unchanged"} == {("move", 1, 10_000 + x, 903), ("delete", 1, 10_000 + y, None)}
    assert {p[1] for p in paths(after)} == {"", "a", "b", "b\\x", "a\\z"}


def test_journal_changes_equal_full_index(spark):
    """What a journal tells of random changes, applied through partial listings, gives the disk as it is now."""
    C = "volume_id long, file_ref long, parent_ref long, name string, is_dir boolean, size long, modified long, gone boolean"
    old, changed, want = [], [], set()
    for v in range(1, 13):
        d = Disk(random.Random(v + 50))
        d.grow(25)
        rows = d.catalog(v)
        rows[0] = (v, v * 10_000, None, "", True, 0, 0, 0)  # the root has reference 0
        old += rows
        before = {k: list(x) for k, x in d.files.items()}
        d.mutate(10)
        for r in before.keys() | d.files.keys():
            if before.get(r) != d.files.get(r):
                n, p, is_dir, s = d.files.get(r) or before[r]
                changed.append((v, r, p, n, is_dir, 0 if is_dir else s, 5, r not in d.files))
        want |= paths(d.listing(v)[1])
    cat = spark.createDataFrame(old, CAT)
    listing, candidates, lost = R.changes_listing(spark.createDataFrame(changed, C), cat)
    assert lost.count() == 0
    ops = R.reconcile(cat, listing, candidates)
    after = [tuple(r) for r in R.apply_reconciled(cat, listing, ops).select("volume_id", "id", "parent_id", "name", "is_dir", "file_ref", "size", "modified").collect()]
    assert paths(after) == want


def test_changes_that_reach_nothing(spark):
    C = "volume_id long, file_ref long, parent_ref long, name string, is_dir boolean, size long, modified long, gone boolean"
    cat = spark.createDataFrame([(1, 1, None, "", True, 5, 0, 0)], CAT)
    rows = [(1, 10, 99, "far", True, 0, 1, False), (1, 11, 10, "below", False, 1, 1, False), (1, 20, 21, "c", True, 0, 1, False), (1, 21, 20, "d", True, 0, 1, False), (1, 30, 5, "ok", False, 1, 1, False), (1, 31, 32, "in gone", False, 1, 1, False), (1, 32, 5, "was", True, 0, 1, True), (None, 1, 1, "x", False, 1, 1, False)]
    listing, candidates, lost = R.changes_listing(spark.createDataFrame(rows, C), cat)
    assert {r["file_ref"] for r in lost.collect()} == {10, 11, 20, 21, 31} and {r["name"] for r in listing.collect()} == {"", "ok"}


def test_refresh_and_graft(spark):
    cat = spark.createDataFrame([(1, 1, None, "", True, None, 0, 0), (1, 2, 1, "old", True, 5, 0, 0), (1, 3, 2, "deep", False, 6, 1, 1), (1, 4, 1, "gone", True, 7, 0, 0)], CAT)
    kids = spark.createDataFrame([(1, 1, "renamed", True, 5, 0, 0), (1, 1, "new", True, 9, 0, 0), (1, 1, "f", False, 8, 1, 1)], "target long, volume_id long, name string, is_dir boolean, file_ref long, size long, modified long")
    listing, to_read = R.refresh_listing(kids, cat)
    new = to_read.first()
    assert to_read.count() == 1 and new["name"] == "new"
    ops = {(r["op"], r["id"]) for r in R.reconcile(cat, listing).collect()}
    assert ops == {("unchanged", 1), ("move", 2), ("insert", None), ("delete", 4)}
    inner = spark.createDataFrame([(1, 50, None, "", True, None, 0, 0, None, None, ""), (1, 51, 50, "new", True, 9, 0, 0, None, None, ""), (1, 52, 51, "a", True, 10, 0, 0, None, None, ""), (1, 53, 52, "b", False, 11, 1, 1, None, None, ""), (1, 54, 50, "else", False, 12, 1, 1, None, None, "")], LIST)
    whole = R.graft(listing, inner.select(*listing.columns), 52, new["node"])
    up = {r["node"]: (r["name"], r["parent_node"]) for r in whole.collect()}
    got = {n: p for n, p in up.values()}
    assert up[got["a"]][0] == "new" and up[got["b"]][0] == "a" and "else" not in got and whole.count() == listing.count() + 2
