"""The two-release list under both ways of anchoring, end to end: files, load, comparison, trace."""

import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from chronotaxa import api, cli
from chronotaxa.operators import fulltext
from chronotaxa.plans import history, model
from chronotaxa.plans.log import Log
from chronotaxa.plans.store import Store, StoreError, Transaction
from chronotaxa.sources.delimited import read_mapped
from chronotaxa.sources.fieldmap import FieldMap, FieldMapError
from chronotaxa.streaming.dropfolder import load_files, watch

HEADER = "taxonID,scientificName,author,rank,status,acceptedNameUsageID,parentNameUsageID,family,genus,vernacularName"
MAP = FieldMap(
    {"source_taxon_id": "taxonID", "scientific_name": "scientificName", "authorship": "author", "rank": "rank", "status": "status", "accepted_taxon_id": "acceptedNameUsageID", "parent_taxon_id": "parentNameUsageID"},
    {"family": "family", "genus": "genus"},
    [{"column": "vernacularName", "language": "en"}],
)
EPITHETS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def rows(release: int) -> list[str]:
    out = []
    synonyms = {6: 5, 15: 14, 16: 14} if release == 1 else {4: 5, 6: 7, 13: 5}
    for k, e in enumerate(EPITHETS, 1):
        if k == (11 if release == 1 else 10):
            continue
        taxon = "T912" if k == 12 and release == 2 else f"T{k:03}"
        name = "gammma" if k == 3 and release == 2 else e
        author = "Jones" if k == 2 and release == 2 else "Smith"
        rank = "subspecies" if k == 9 and release == 2 else "species"
        parent = f"G00{release}" if k == 8 else ""
        accepted = f"T{synonyms[k]:03}" if k in synonyms else ""
        out.append(f"{taxon},Testia {name},{author},{rank},{'synonym' if accepted else 'accepted'},{accepted},{parent},Testiaceae,Testia,{e} test-plant")
    genera = ["Testia"] if release == 1 else ["Testia", "Testiella"]
    return out + [f"G{i + 1:03},{g},Smith,genus,accepted,,,Testiaceae,{g}," for i, g in enumerate(genera)]


EXPECTED = {
    "persistent": dict(author_changed=1, renamed=1, status_changed=4, accepted_changed=5, reclassified=1, rank_changed=1, lumped=1, split=1, id_replaced=1, added=2, removed=1),
    "unstable": dict(author_changed=1, status_changed=4, accepted_changed=5, reclassified=1, rank_changed=1, lumped=1, split=1, probable_rename=1, added=3, removed=2),
}


@pytest.fixture(scope="module", params=["persistent", "unstable"])
def compared(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    store = Store(spark, str(folder / "store"))
    store.add_checklist("demo", "Demo list", request.param)
    reports = []
    for r, version in ((1, "2023.1"), (2, "2024.1")):
        path = folder / f"{version}.csv"
        path.write_text("﻿" + HEADER + "\n" + "\n".join(rows(r)) + "\n", encoding="utf-8")
        reports.append(store.ingest("demo", version, read_mapped(spark, str(path), MAP), sha256=str(r)).report.first())
    store.diff("demo", "2023.1", "2024.1")
    return request.param, store, reports


def details(store, kind):
    return [json.loads(r["detail"]) for r in history.change_list(store, "demo", "2023.1", "2024.1", kind).collect()]


def test_counts(compared):
    mode, store, reports = compared
    assert {r["type"]: r["n"] for r in history.counts(store.read("change")).collect()} == EXPECTED[mode]
    assert store.read("usage_track").count() == 33 and store.read("name").count() == 20
    assert (reports[0]["rows_read"], reports[0]["names_created"], reports[1]["names_created"], reports[1]["names_reused"]) == (16, 16, 4, 13)
    assert reports[0]["accepted_resolved"] == 3 and reports[1]["parent_resolved"] == 1
    assert history.report(store.read("change")).splitlines()[-1].split()[-1] == str(sum(EXPECTED[mode].values()))


def test_details(compared):
    mode, store, _ = compared
    assert details(store, "lumped") == [{"into": "Testia epsilon", "sources": ["Testia delta", "Testia epsilon", "Testia nu"], "sunk": ["Testia delta", "Testia nu"], "count": 3}]
    assert details(store, "split") == [{"from": "Testia xi", "into": ["Testia omicron", "Testia pi", "Testia xi"], "count": 3}]
    assert details(store, "author_changed") == [{"name": "Testia beta", "from_author": "Smith", "to_author": "Jones"}]
    assert {"name": "Testia delta", "from_accepted": None, "to_accepted": "Testia epsilon"} in details(store, "accepted_changed")
    if mode == "persistent":
        assert details(store, "id_replaced") == [{"name": "Testia mu", "from_id": "T012", "to_id": "T912"}]
        assert details(store, "renamed") == [{"from_name": "Testia gamma", "to_name": "Testia gammma"}]
    else:
        row = store.read("change").where("type = 'probable_rename'").first()
        assert row["confidence"] == 96.0 and json.loads(row["detail"])["advisory"] is True
    no_track = {r["type"] for r in store.read("change").where("track_id is null").collect()}
    assert no_track == {"lumped", "split"}


def test_guards(compared, spark):
    _, store, _ = compared
    with pytest.raises(StoreError):
        store.diff("demo", "2023.1", "2024.1")
    with pytest.raises(StoreError):
        store.diff("demo", "2023.1", "2023.1")
    with pytest.raises(StoreError):
        store.diff("demo", "2023.1", "2099")
    before = store.read("change").count()
    store.diff("demo", "2023.1", "2024.1", force=True)
    assert store.read("change").count() == before and store.read("usage_track").count() == 33
    with pytest.raises(StoreError, match="this very file"):
        store.ingest("demo", "2023.1", spark.createDataFrame([], model.SOURCE_ROW), sha256="1")
    with pytest.raises(StoreError):
        store.add_checklist("demo", "again")
    with pytest.raises(StoreError):
        store.set_checklist("demo", "sometimes")


def test_trace_tiers_and_api(compared):
    mode, store, _ = compared
    assert history.trace(store, "Testia zeta Smith")["tier"] == "exact"
    two = history.trace(store, "Testia beta")
    assert two["tier"] == "canonical" and two["ambiguous"] and len(two["traces"]) == 2 and len(two["traces"][0]["related"]) == 1
    fuzzy = history.trace(store, "Testia gama")
    assert fuzzy["tier"] == "fuzzy" and "Testia gamma Smith" in {t["name"] for t in fuzzy["traces"]} and min(fuzzy["scores"].values()) >= 88
    for q in ("Quercus glauca", " ", 'Testia "zeta', "Testia (zeta)", "Testia*", "-"):
        assert history.trace(store, q)["tier"] in ("none", "fuzzy", "canonical", "exact")
    delta = history.trace(store, "Testia delta Smith")["traces"][0]["checklists"][0]
    assert delta["first_seen"] == "2023.1" and delta["last_seen"] == "2024.1" and delta["anchor_kind"] == ("source_id" if mode == "persistent" else "name")
    assert {c["type"] for c in delta["appearances"][1]["changes"]} == {"status_changed", "accepted_changed"}
    assert delta["appearances"][1]["accepted_name"] == "Testia epsilon Smith"
    assert api.respond(store, "/healthz")[0] == 200 and api.respond(store, "/api/trace?name=")[0] == 422 and api.respond(store, "/nothing")[0] == 404
    assert json.loads(api.respond(store, "/api/checklists")[2])[0]["code"] == "demo"
    assert "Testia" in api.respond(store, "/?name=Testia+zeta")[2]


def test_check_ids_and_text(compared):
    _, store, _ = compared
    row = history.check_ids(store, "demo", "2023.1", "2024.1").first()
    assert (row["ids_before"], row["ids_after"], row["ids_shared"], row["names_shared"]) == (16, 17, 14, 14) and row["verdict"] == "persistent"
    assert "Demo list" in history.releases_text(store)


def test_replace_and_drop(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D")
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\n" + "\n".join(rows(1)) + "\n", encoding="utf-8")
    store.ingest("d", "1", read_mapped(spark, str(path), MAP))
    store.ingest("d", "1", read_mapped(spark, str(path), MAP), replace=True)
    assert store.read("usage").count() == 16 and store.read("name").count() == 16 and store.read("release").count() == 1
    store.drop_release("d", "1")
    assert store.read("usage").count() == 0 and store.read("name").count() == 16
    with pytest.raises(StoreError, match="no usable row"):
        store.ingest("d", "2", spark.createDataFrame([], model.SOURCE_ROW))
    assert store.read("release").first()["status"] == "failed"


def test_stream_of_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D", "persistent")
    folder = tmp_path / "in"
    folder.mkdir()
    for r, day in ((1, "20230101"), (2, "20240101")):
        (folder / f"list_{day}.csv").write_text(HEADER + "\n" + "\n".join(rows(r)) + "\n", encoding="utf-8")
    for _ in range(2):  # a second run finds everything loaded
        watch(spark, store, "d", str(folder), lambda p: read_mapped(spark, p, MAP), str(tmp_path / "c")).awaitTermination()
    assert [r["version"] for r in store.ordered_releases("d").collect()] == ["2023.01.01", "2024.01.01"]
    assert store.read("change").count() == 19


def test_field_map_errors(tmp_path, spark):
    with pytest.raises(FieldMapError):
        FieldMap({"rank": "r"})
    with pytest.raises(FieldMapError):
        FieldMap({"scientific_name": "n", "colour": "c"})
    with pytest.raises(FieldMapError):
        FieldMap({"scientific_name": "n"}, status_values={"ok": "fine"})
    with pytest.raises(FieldMapError, match="missing_column"):
        FieldMap({"scientific_name": "missing_column"}).check_header(["a"])
    (tmp_path / "m.yml").write_text("fields: {scientific_name: n}\nstatus_values: {' OK ': accepted}\n")
    assert FieldMap.from_yaml(tmp_path / "m.yml").status_values == {"ok": "accepted"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + "\n".join(rows(1)) + "\n", encoding="utf-8")
    (tmp_path / "m.yml").write_text("fields: {source_taxon_id: taxonID, scientific_name: scientificName, authorship: author, status: status}\n")
    run = lambda *a: cli.run(cli.parser().parse_args(["--store", str(tmp_path / "s"), *a]), spark)
    assert cli.main(["version"]) == 0
    assert run("checklist", "add", "c", "C") == "added c"
    assert json.loads(run("ingest", "c", "1", str(tmp_path / "a.csv"), "--map", str(tmp_path / "m.yml")))["usages"] == 16
    assert "C" in run("checklist", "list") and json.loads(run("health"))["names"] == 16
    assert json.loads(run("trace", "Testia xi"))["tier"] == "canonical"


def test_failed_replacement_keeps_the_release(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D", "persistent")
    lines = {"1": rows(1), "2": rows(2)}
    for version, body in lines.items():
        (tmp_path / f"{version}.csv").write_text(HEADER + "\n" + "\n".join(body) + "\n", encoding="utf-8")
        store.ingest("d", version, read_mapped(spark, str(tmp_path / f"{version}.csv"), MAP))
    store.diff("d", "1", "2")
    held = {t: store.read(t).count() for t in ("usage", "usage_track", "change", "release")}
    twice = tmp_path / "twice.csv"
    twice.write_text(HEADER + "\n" + "\n".join([rows(1)[0]] * 2) + "\n", encoding="utf-8")
    with pytest.raises(model.IntegrityError):
        store.ingest("d", "1", read_mapped(spark, str(twice), MAP), replace=True)
    with pytest.raises(StoreError, match="stays"):
        store.ingest("d", "1", spark.createDataFrame([], model.SOURCE_ROW), replace=True)
    assert held == {t: store.read(t).count() for t in held}
    store.ingest("d", "1", read_mapped(spark, str(tmp_path / "1.csv"), MAP), replace=True)
    assert store.read("change").count() == 0 and store.read("release").count() == 2 and store.read("usage").count() == held["usage"]


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["name", "posting", "fact", "usage", "release", "commit"])
def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, step):
    """A fault at any write, or at the commit itself, leaves readers on the old snapshot; loading again mends it."""
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D")
    lines = spark.createDataFrame([(0, "a", "Testia alpha Smith"), (1, "b", "Testia beta Smith")], "file_ord long, source_taxon_id string, scientific_name string")
    file = lines.select(*(F.col(f.name) if f.name in lines.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in model.SOURCE_ROW))
    held = store.log.latest()
    write, commit = Transaction._write, Log.commit

    def failing(self, table, df):
        out = write(self, table, df)
        if table == step:
            raise Broken(table)
        return out

    def no_commit(*_):
        raise Broken("commit")

    with monkeypatch.context() as m:
        m.setattr(Transaction, "_write", failing)
        if step == "commit":
            m.setattr(Log, "commit", no_commit)
        with pytest.raises(Broken):
            store.ingest("d", "1", file)
    assert store.log.latest() == held and store.read("name").count() == store.read("usage").count() == store.read("posting").count() == store.read("release").count() == 0
    assert not list((tmp_path / "s" / "name").glob("commit=*")) and commit is Log.commit
    store.ingest("d", "1", file)
    assert store.read("usage").count() == 2 and store.read("posting").where("word = 'testia'").count() == 2


def test_concurrent_loads(spark, tmp_path, monkeypatch):
    """Of two loads that began with one snapshot the second does its work again; both are there, and shared names only once."""
    root = str(tmp_path / "s")
    Store(spark, root).add_checklist("d", "D")
    paths = []
    for r in (1, 2):
        paths.append(tmp_path / f"{r}.csv")
        paths[-1].write_text(HEADER + "\n" + "\n".join(rows(r)) + "\n", encoding="utf-8")
    tried, commit, begun = [], Log.commit, threading.Barrier(2)

    def together(self, base, tables):
        tried.append(base.number)
        if len(tried) <= 2:
            begun.wait(timeout=300)
        return commit(self, base, tables)

    monkeypatch.setattr(Log, "commit", together)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: Store(spark, root).ingest("d", str(r), read_mapped(spark, str(paths[r - 1]), MAP)), (1, 2)))
    store = Store(spark, root)
    assert tried == [1, 1, 2] and store.log.latest().number == 3
    assert store.read("release").count() == 2 and store.read("usage").count() == 33 and store.read("name").count() == 20
    assert {r["seq"] for r in store.read("release").collect()} == {1, 2}


def test_readers_keep_their_snapshot_and_old_ones_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D")
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\n" + "\n".join(rows(1)) + "\n", encoding="utf-8")
    store.ingest("d", "1", read_mapped(spark, str(path), MAP))
    before, old = store.log.latest(), store.read("usage")
    store.drop_release("d", "1")
    assert old.count() == store.read("usage", before).count() == 16 and store.read("usage").count() == 0
    gone = store.log.vacuum(keep=1)
    assert any(g.startswith("usage/") for g in gone) and store.log.numbers() == [before.number + 1] and store.read("name").count() == 16


def test_index_follows_loads(spark, tmp_path):
    """The stored index equals one built anew, after each load and when merged; a search reads its buckets only."""
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D")
    same = lambda index: sorted(map(str, index.postings.select("word", "name_id", "len", "positions").collect()))
    for r in (1, 2):
        path = tmp_path / f"{r}.csv"
        path.write_text(HEADER + "\n" + "\n".join(rows(r)) + "\n", encoding="utf-8")
        store.ingest("d", str(r), read_mapped(spark, str(path), MAP))
        fresh = fulltext.build(store.read("name"))
        assert same(store.index()) == same(fresh)
        assert store.index().facts.agg(F.sum("n"), F.sum("tokens")).first() == fresh.facts.first()
    asked = spark.createDataFrame([(1, "gamma")], "query_id long, text string")
    plan = fulltext.ranked(store.index(), asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    want = sorted(map(tuple, fulltext.ranked(store.index(), asked, 10).collect()))
    folders = len(store.log.latest().folders("posting"))
    store.merge_index()
    assert folders == 2 and len(store.log.latest().folders("posting")) == 1 and same(store.index()) == same(fresh)
    assert sorted(map(tuple, fulltext.ranked(store.index(), asked, 10).collect())) == want


def test_a_trace_skips_other_names(spark, tmp_path):
    """Rows that scans hand on for one name stay as few when a thousand other names are stored beside it."""
    store = Store(spark, str(tmp_path / "s"), rows_per_file=20)
    store.add_checklist("d", "D")
    cols = "file_ord long, source_taxon_id string, scientific_name string, accepted_taxon_id string, status_raw string"
    given = {c.split()[0] for c in cols.split(", ")}
    file = lambda rows_: spark.createDataFrame(rows_, cols).select(*(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in model.SOURCE_ROW))
    store.ingest("d", "1", file([(0, "a", "Testia alpha Smith", "b", "synonym"), (1, "b", "Testia beta Smith", None, "accepted")]))

    def scanned():
        wanted = store.read("name").where("canonical_name = 'Testia alpha'").select("name_id")
        docs = history.traces(store, wanted)
        assert docs.first()["checklists"][0]["appearances"][0]["accepted_name"] == "Testia beta Smith"
        df = store.read("usage").where(F.col("name_id").isin([r[0] for r in wanted.collect()]))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))

    first = scanned()
    letters = "abcdefghij"
    store.ingest("d", "2", file([(k, f"x{k}", "Otheria " + "".join(letters[int(c)] for c in f"{k:03}") + "us Smith", None, "accepted") for k in range(1000)]))
    assert scanned() <= first + 40


def test_release_stability_is_told_before_comparing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add_checklist("d", "D", "persistent")
    for r, day in ((1, "20230101"), (2, "20240101")):
        (tmp_path / f"list_{day}.csv").write_text(HEADER + "\n" + "\n".join(rows(r)) + "\n", encoding="utf-8")
    said = []
    pairs = load_files(store, "d", [str(p) for p in sorted(tmp_path.glob("*.csv"))], lambda p: read_mapped(spark, p, MAP), lambda text: said.append((text, store.read("change").count())))
    assert pairs == [("2023.01.01", "2024.01.01")] and len(said) == 1 and said[0][1] == 0 and "identifiers" in said[0][0] and store.read("change").count() == 19


def test_targets(spark):
    usages = spark.createDataFrame([(1, None), (2, 1)], "usage_id long, accepted_usage_id long")
    model.require_targets(usages, "accepted_usage_id", usages, "usage_id")
    with pytest.raises(model.IntegrityError, match="leads nowhere"):
        model.require_targets(usages.where("usage_id = 2"), "accepted_usage_id", usages.where("usage_id = 2"), "usage_id")


def test_texts_for_readers(spark, tmp_path):
    run = lambda *a: cli.run(cli.parser().parse_args(["--store", str(tmp_path / "s"), *a]), spark)
    (tmp_path / "m.yml").write_text("fields: {source_taxon_id: taxonID, scientific_name: scientificName, authorship: author, status: status, accepted_taxon_id: acceptedNameUsageID}\n")
    run("checklist", "add", "c", "C")
    for r in (1, 2):  # one name is listed under two identifiers
        extra = [rows(r)[0].replace("T001", "T999")]
        (tmp_path / f"{r}.csv").write_text(HEADER + "\n" + "\n".join(rows(r) + extra) + "\n", encoding="utf-8")
        run("ingest", "c", str(r), str(tmp_path / f"{r}.csv"), "--map", str(tmp_path / "m.yml"))
    report = run("diff", "run", "c", "1", "2")
    assert report.startswith("anchored by name") and "2 ambiguous anchor(s): testia alpha, testia alpha" in report and "inferred" in report
    assert "identifiers" in run("checklist", "check-ids", "c", "1", "2", "--text") and "persistent" in run("checklist", "check-ids", "c", "1", "2", "--text")
    text = run("trace", "Testia delta", "--text")
    assert text.startswith("1 name(s), canonical") and "synonym of Testia epsilon" in text and "* status_changed" in text
    assert run("trace", "Quercus glauca", "--text").startswith("no name matches")
    store = Store(spark, str(tmp_path / "s"))
    track = store.read("track").where("anchor_key = 'testia delta'").first()["track_id"]
    assert [(r["version"], r["status"]) for r in history.thread(store, track).collect()] == [("1", "accepted"), ("2", "synonym")]
