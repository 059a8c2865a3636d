"""The programs on files, from a shard's run to a walk-forward, and with spoilt inputs."""

import json
import shutil

import numpy as np
import pytest

from gridloom.__main__ import main
from gridloom.config import Costs, expected_provenance, layered
from gridloom.plans import training
from gridloom.plans import walk_forward as wf
from gridloom.sources import artefacts, manifest, sinks
from tests.helpers import day
from tests.test_shards import AXES, HEX, PROVENANCE, rewrite
from tests.test_sources import archive, line

WINDOWS = [
    {"id": "w1", "train_start": "2018-01-02", "train_end": "2018-06-30", "oos_start": "2018-07-01", "oos_end": "2018-12-31"},
    {"id": "w2", "train_start": "2018-04-02", "train_end": "2018-12-31", "oos_start": "2019-01-01", "oos_end": ""},
]
GRID = ["--gap-min=5", "--gap-max=6", "--signal-min=2", "--signal-max=3", "--momentum-min=5", "--momentum-max=6", f"--provenance={json.dumps(PROVENANCE)}"]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Candle files of three tickers, and for each window the artefact that the programs
    run, reduce and manifest make of its training span."""
    at = tmp_path_factory.mktemp("programs")
    draw = np.random.default_rng(31)
    dates = np.busday_offset("2017-01-02", np.arange(640))
    for name in ("aaa", "bbb", "ccc"):
        close = 20 * np.cumprod(1 + draw.normal(0.0005, 0.015, len(dates)))
        rows = [f"{d},{c * 1.002:.6f},{c:.6f}" for d, c in zip(dates, close, strict=True)]
        (at / f"{name}_1d.csv").write_text("date,open,close\n" + "\n".join(rows) + "\n")
    (at / "universe.json").write_text(json.dumps({"tickers": ["AAA", "BBB", "CCC"]}))
    (at / "windows.json").write_text(json.dumps({"windows": WINDOWS}))
    (at / "src" / "deep").mkdir(parents=True)
    (at / "src" / "a.py").write_text("a = 1\n")
    (at / "src" / "deep" / "b.py").write_text("b = 2\n")
    for w in WINDOWS:
        span = [f"--start={w['train_start']}", f"--end={w['train_end']}"]
        assert main(["run", f"--results={at}/grid/{w['id']}", *files(at), *span, *GRID], spark) == 0
        assert main(["reduce", f"--results={at}/grid/{w['id']}", f"--output={at}/training/{w['id']}", "--top=4", *files(at), *span, *GRID], spark) == 0
        assert finalise(spark, at, w["id"]) == 0
    return at


def files(at):
    return [f"--candles={at}/*_1d.csv", f"--universe={at}/universe.json"]


def finalise(spark, at, name, *more):
    folder = f"{at}/training/{name}"
    return main(["manifest", f"--manifest={folder}/manifest.json", f"--root={at}/src", f"--top={folder}/top.csv", f"--optimizer-sha={HEX[:40]}", "--mode=training_only", "--required", "a.py", "deep/b.py", *more], spark)


def walk(spark, at, *more):
    return main(["walk-forward", f"--windows={at}/windows.json", f"--training={at}/training", f"--output={at}/forward", *files(at), *more], spark)


def test_walk_forward_takes_each_windows_own_leader(spark, base, capsys):
    for more in ((), ("--as-of",)):
        assert walk(spark, base, *more) == 0
        told = json.loads((base / "forward" / "walk_forward.json").read_text())
        assert [w["window_id"] for w in told["windows"]] == ["w1", "w2"] and told["windows"][0]["start_equity"] == 1000.0
        assert told["windows"][1]["start_equity"] == told["windows"][0]["end_equity"] and told["final_equity"] == told["windows"][1]["end_equity"]
        for w in told["windows"]:
            top = spark.read.csv(f"{base}/training/{w['window_id']}/top.csv", header=True, inferSchema=True).toPandas()
            top = top.sort_values(["final_equity", "gap_period", "signal_period", "momentum_period"], ascending=[False, True, True, True]).iloc[0]
            assert [w[c] for c in ("gap_period", "signal_period", "momentum_period", "vol_period")] == [int(top[c]) for c in ("gap_period", "signal_period", "momentum_period", "vol_period")]
    assert "# Walk-forward" in (base / "forward" / "walk_forward.md").read_text()
    assert walk(spark, base, "--end=2018-10-31") == 0  # the second window starts later
    assert len(json.loads((base / "forward" / "walk_forward.json").read_text())["windows"]) == 1


def test_out_of_sample_replays_the_best_in_training_order(spark, base):
    call = lambda *more: main(["oos", f"--training={base}/training/w1", f"--output={base}/oos", *files(base), *more], spark)
    assert call("--start=2018-07-01", "--top=3") == 0
    told = json.loads((base / "oos" / "oos.json").read_text())
    assert [r["training_rank"] for r in told["results"]] == [1, 2, 3] and told["oos_end"] == "2019-06-14" and told["training_end"] == "2018-06-29"
    assert "| 1 |" in (base / "oos" / "oos.md").read_text()
    assert call("--start=2018-06-29") == 1 and call("--start=2018-07-01", "--top=5") == 1 and call("--start=2018-07-01", "--fee-bps=3") == 1
    with pytest.raises(ValueError):
        call("--start=2018-07-01", "--top=0")


@pytest.fixture
def spoil(base):
    """Changes the first window's manifest, and puts it right again."""
    at = base / "training" / "w1" / "manifest.json"
    good = at.read_text()

    def change(*path, value):
        found = json.loads(good)
        inside = found
        for k in path[:-1]:
            inside = inside[k]
        inside[path[-1]] = value
        rewrite(at, json.dumps(found))

    yield change
    rewrite(at, good)


@pytest.mark.parametrize(
    ("path", "value", "problem"),
    [
        (("schema_version",), 1, "schema"), (("optimizer_sha",), "abc", "optimizer_sha"), (("upstream_sha",), None, "upstream_sha"), (("optimizer_source_sha256",), {}, "source hashes"),
        (("optimizer_source_sha256",), {"a.py": "no"}, "source hashes"), (("selection_provenance", "mode"), "in_sample_full", "mode"), (("selection_provenance", "training_end"), "2018-06-28", "dates"),
        (("execution", "end"), "2018-07-31", "leak"), (("execution", "end"), "2018-06-15", "window"), (("execution", "start"), "2018-01-03", "window"), (("execution", "fee_bps_per_side"), "none", "costs"),
        (("execution", "initial_cash"), 1000.5, "costs"), (("selection_provenance", "top_100_sha256"), HEX, "top rows"), (("execution",), {}, "training span"),
    ],
)
def test_a_spoilt_artefact_stops_the_walk(spark, base, spoil, path, value, problem, capsys):
    spoil(*path, value=value)
    assert walk(spark, base) == 1
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["status"] == "FAIL" and ["w1", problem] in said["problems"] and not any(w == "w2" for w, _ in said["problems"])


def gate(spark, base, windows=WINDOWS, **more):
    rows = spark.createDataFrame([tuple(w.values()) for w in windows], "id string, train_start string, train_end string, oos_start string, oos_end string")
    folders = f"{base}/training/*"
    found = training.gate(rows, artefacts.facts(artefacts.manifests(spark, folders)), artefacts.top_hashes(spark, folders), artefacts.tops(spark, folders), Costs(), **more)
    return {tuple(r) for r in found.collect()}


def test_gate_agrees_with_the_check_of_one_manifest(spark, base, spoil):
    """The plan over all windows and the check of a single manifest say the same."""
    sha = {r["artefact"]: r["sha256"] for r in artefacts.top_hashes(spark, f"{base}/training/*").collect()}
    window = wf.WindowRow(*WINDOWS[0].values())
    assert gate(spark, base) == set()
    wf.verify_training(json.loads((base / "training" / "w1" / "manifest.json").read_text()), window, Costs(), sha["w1"])
    for path, value in ((("upstream_sha",), "q"), (("selection_provenance", "training_start"), "2018-01-03"), (("execution", "odd_lot_extra_bps_weighted"), 4)):
        spoil(*path, value=value)
        with pytest.raises(ValueError) as e:
            wf.verify_training(json.loads((base / "training" / "w1" / "manifest.json").read_text()), window, Costs(), sha["w1"])
        assert all(p in str(e.value) for w, p in gate(spark, base) if p not in ("window", "dates"))


def test_windows_without_artefact_or_order_fail(spark, base):
    other = [*WINDOWS, WINDOWS[1] | {"id": "w3"}]
    assert gate(spark, base, other) == {("w3", "artefact")}
    rows = lambda *w: spark.createDataFrame(list(w), "id string, train_start string, train_end string, oos_start string, oos_end string")
    found = training.order_problems(rows(("a", "2018-01-01", "2018-02-01", "2018-02-01", "2018-03-01"), ("b", "2018-01-01", "2018-02-01", "2018-03-01", "2018-02-15"), ("c", "2018-01-01", "soon", "2018-05-01", ""), ("d", "2018-01-01", "2018-02-01", "2018-06-01", ""), ("d", "2018-01-01", "2018-02-01", "2018-07-01", "")))
    assert {tuple(r) for r in found.collect()} == {("a", "training"), ("b", "empty"), ("b", "overlap"), ("c", "date"), ("c", "training"), ("d", "overlap"), ("d", "repeated")}
    (base / "none.json").write_text(json.dumps({"windows": []}))
    assert main(["walk-forward", f"--windows={base}/none.json", f"--training={base}/training", f"--output={base}/x", *files(base)], spark) == 1


def test_latest_training_is_as_of(spark):
    windows = spark.createDataFrame([("w", "2018-01-01", "2018-12-31"), ("v", "2019-01-01", "2019-12-31")], "id string, train_start string, train_end string")
    trained = [("late", "2018-01-01", "2019-01-01"), ("best", "2018-01-01", "2018-12-28"), ("older", "2018-01-01", "2018-12-24"), ("old", "2018-01-01", "2018-12-01"), ("other", "2018-01-02", "2018-12-31"), ("bad", "2018-01-01", "never")]
    found = training.latest_training(windows, spark.createDataFrame(trained, "artefact string, training_start string, training_end string"))
    assert {tuple(r) for r in found.collect()} == {("w", "best", "2018-12-28"), ("v", None, None)}


def test_facts_fall_back_and_survive_anything(spark):
    rows = [
        ("a", json.dumps({"schema_version": 3, "training": {"start": "", "end": "2018-06-01"}, "execution": {"start": "2018-01-01", "end": "x", "fee_bps_per_side": "3.25"}, "optimizer_source_sha256": {"p/q.py": HEX}})),
        ("b", json.dumps({"schema_version": "three", "training": [], "execution": {"fee_bps_per_side": {}}, "optimizer_source_sha256": ["x"], "selection_provenance": "text"})),
        ("c", "{not json"), ("d", None), ("e", "[1, 2]"),
    ]
    found = {r["artefact"]: r.asDict() for r in artefacts.facts(spark.createDataFrame(rows, "artefact string, manifest string")).collect()}
    a = found["a"]
    assert (a["training_start"], a["training_end"], a["fee_bps"], a["sources"], a["schema_version"]) == ("2018-01-01", "2018-06-01", 3.25, {"p/q.py": HEX}, 3)
    assert all(v is None for r in "bcde" for k, v in found[r].items() if k != "artefact")


def test_robustness(spark, base):
    call = lambda results, *more: main(["robustness", f"--results={results}", f"--output={base}/robust", *more], spark)
    assert call(f"{base}/grid/w1/shard_*.csv", "--radius=1") == 0
    told = json.loads((base / "robust" / "robustness.json").read_text())
    assert told["rows"] == 8 and told["neighbourhood"]["count"] == 8 and len(told["one_step"]) == 3
    assert call(f"{base}/grid/*/shard_*.csv") == 1 and call(f"{base}/grid/w1/shard_*.csv", "--vol=99") == 1  # repeated, empty
    with pytest.raises(ValueError):
        call(f"{base}/grid/w1/shard_*.csv", "--radius=-1")


def test_manifest_is_final_once_and_tells_changed_files(spark, base, tmp_path, capsys):
    assert finalise(spark, base, "w1") == 1 and "final already" in capsys.readouterr().out
    check = lambda: (main(["manifest", "--check", f"--manifest={base}/training/w1/manifest.json", f"--root={base}/src", f"--top={base}/training/w1/top.csv"], spark), json.loads(capsys.readouterr().out.splitlines()[-1])["problems"])
    assert check() == (0, [])
    good = (base / "src" / "a.py").read_text()
    (base / "src" / "a.py").write_text("a = 3\n")
    (base / "src" / "c.py").write_text("c\n")
    (base / "src" / "deep" / "b.py").rename(tmp_path / "b.py")
    status, problems = check()
    assert status == 1 and sorted(problems) == [["a.py", "changed"], ["c.py", "new"], ["deep/b.py", "missing"]]
    (base / "src" / "a.py").write_text(good)
    (base / "src" / "c.py").unlink()
    (tmp_path / "b.py").rename(base / "src" / "deep" / "b.py")
    assert check() == (0, [])
    shutil.copytree(base / "training" / "w1", tmp_path / "w9")
    sinks.write_json(spark, {"execution": {}}, f"{tmp_path}/m.json")
    with pytest.raises(ValueError, match="must be there"):
        manifest.finalise(spark, f"{tmp_path}/m.json", f"{base}/src", ["*"], ["z.py"], f"{tmp_path}/w9/top.csv", HEX[:40], "training_only")
    with pytest.raises(ValueError, match="none of"):
        manifest.finalise(spark, f"{tmp_path}/m.json", f"{base}/src", ["*"], [], f"{tmp_path}/w9/top.csv", HEX[:40], "other")
    with pytest.raises(ValueError, match="isn't final"):
        manifest.verify(spark, f"{tmp_path}/m.json", f"{base}/src")


def test_layers_of_settings():
    env, meta = {"FEE_BPS": "2.5", "SHARDS": ""}, {"fee_bps": 1.0, "shards": 4, "slippage_bps": "x"}
    assert layered("fee_bps", float, 0.0, "FEE_BPS", env, meta) == layered("fee_bps", float, 0, "FEE_BPS", {}, {})
    assert [layered("fee_bps", float, v, "FEE_BPS", e, meta).source for v, e in ((0.0, env), (None, env), (None, {}))] == ["argument", "environment", "metadata"]
    assert layered("shards", int, None, "SHARDS", env, meta).value == 4
    for name, e in (("slippage_bps", {}), ("odd_lot_extra_bps", {}), ("fee_bps", {"V": "much"})):
        with pytest.raises(ValueError):
            layered(name, float, None, "V", e, {k: v for k, v in meta.items() if k != "fee_bps"})


def test_snapshot_metadata_are_a_precondition():
    good = {"status": "PASS", "upstream_sha": HEX[:40], "universe_sha256": HEX, "requested_end": "2019-06-28"}
    assert expected_provenance({"GITHUB_RUN_ID": "5"}, good) == {"github_run_id": "5", "optimizer_sha": "", "github_repository": "", "snapshot_upstream_sha": HEX[:40], "snapshot_universe_sha256": HEX, "snapshot_requested_end": "2019-06-28"}
    for change in ({"status": "FAIL"}, {"upstream_sha": ""}, {"requested_end": None}):
        with pytest.raises(ValueError):
            expected_provenance({}, good | change)


def test_audit_takes_each_setting_from_its_layer(spark, base, capsys, monkeypatch):
    call = lambda *more: (main(["audit", f"--results={base}/grid/w1", *GRID[:-1], *more], spark), json.loads(capsys.readouterr().out.splitlines()[-1]))
    for v in ("SHARDS", "FEE_BPS", "SLIPPAGE_BPS", "ODD_LOT_EXTRA_BPS"):
        monkeypatch.delenv(v, raising=False)
    status, said = call(f"--universe={base}/universe.json")
    assert status == 0 and {v[1] for v in said["settings"].values()} == {"metadata"}
    monkeypatch.setenv("FEE_BPS", "3.0")
    status, said = call("--shards=1")
    assert status == 1 and [0, "fee_bps"] in said["problems"] and said["settings"]["fee_bps"] == [3.0, "environment"] and said["settings"]["shards"] == [1, "argument"]
    assert call("--fee-bps=3.25")[0] == 0
    (base / "few.json").write_text(json.dumps({"tickers": ["ZZZ"]}))
    status, said = call("--fee-bps=3.25", f"--universe={base}/few.json")
    assert status == 1 and "final_holding" in said["problems"][0][1]
    for meta, wanted in (({"status": "FAIL"}, "PASS"), ({"status": "PASS"}, "upstream_sha")):
        (base / "snapshot.json").write_text(json.dumps(meta))
        status, said = call("--fee-bps=3.25", f"--snapshot-meta={base}/snapshot.json")
        assert status == 1 and wanted in said["problems"][0]
    monkeypatch.setenv("GITHUB_RUN_ID", "78")
    (base / "snapshot.json").write_text(json.dumps({"status": "PASS", "upstream_sha": PROVENANCE["snapshot_upstream_sha"], "universe_sha256": HEX, "requested_end": "2019-06-28"}))
    assert [0, "expected github_run_id"] in call("--fee-bps=3.25", f"--snapshot-meta={base}/snapshot.json")[1]["problems"]
    monkeypatch.setenv("GITHUB_RUN_ID", "77")
    assert call("--fee-bps=3.25", f"--snapshot-meta={base}/snapshot.json")[0] == 0
    assert main(["audit", f"--results={base}/nowhere", *AXES[:-2]], spark) == 1


def test_snapshot_and_calendar_programs(spark, tmp_path, capsys):
    dates = [str(d) for d in np.busday_offset("2019-01-01", np.arange(30), roll="forward")]
    archive(tmp_path / "a.zip", [line("00"), *(line("01", d.replace("-", "")) for d in dates), line("99")])
    for name in ("aaa", "bbb"):
        (tmp_path / f"{name}_1d.csv").write_text("date,open,close\n" + "".join(f"{d},10,{10 + i % 3}\n" for i, d in enumerate(dates)))
    (tmp_path / "u.json").write_text(json.dumps({"tickers": ["AAA", "BBB"]}))
    event = {"ticker": "AAA", "ex_date": "2019-01-10", "last_date_prior": "2019-01-09", "split_ratio": 2.0, "event": "split", "source_authority": "issuer", "source_url": "https://example.org"}
    (tmp_path / "events.json").write_text(json.dumps({"schema_version": 1, "events": [event]}))
    assert main(["calendar", f"--calendar={tmp_path}/cal", f"--archives={tmp_path}/*.zip", f"--requested-end={dates[-1]}"], spark) == 0
    call = lambda *more: (main(["snapshot", f"--calendar={tmp_path}/cal", f"--requested-end={dates[-1]}", f"--candles={tmp_path}/*_1d.csv", f"--universe={tmp_path}/u.json", f"--overrides={tmp_path}/events.json", "--upstream-sha=1", "--start=2019-01-01", "--tickers=2", "--least-rows=20", f"--output={tmp_path}/out", *more], spark), json.loads(capsys.readouterr().out.splitlines()[-1]))
    assert call()[0] == 0
    told = json.loads((tmp_path / "out" / "snapshot.json").read_text())
    assert told["status"] == "PASS" and len(told["candle_sha256"]) == 2 and expected_provenance({}, told | {"upstream_sha": HEX})
    assert call("--must", "AAA", "--must-not", "ZZZ")[0] == 0 and call("--must", "ZZZ")[1]["blocking"] == [[None, "universe members"]] and call("--must-not", "AAA")[0] == 1
    (tmp_path / "bbb_1d.csv").write_text("date,open,close\n" + "".join(f"{d},10,10\n" for d in [dates[1], dates[0], *dates[2:12]]) + "2019-01-05,0,10\n")
    (tmp_path / ".bbb_1d.csv.crc").unlink(missing_ok=True)
    (tmp_path / "events.json").write_text(json.dumps({"events": [event | {"ticker": "CCC"}]}))
    status, said = call()
    assert status == 1 and {tuple(b) for b in said["blocking"]} == {("BBB", r) for r in ("order", "prices", "outside the calendar", "history", "coverage", "stale")} | {("CCC", "override: not in universe")}
    rewrite(tmp_path / "cal" / "sessions.json", "{}")
    assert main(["calendar", f"--calendar={tmp_path}/cal", f"--archives={tmp_path}/*.zip", f"--requested-end={dates[-1]}"], spark) == 1


def test_hash_tree_equals_brute_force(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("r.md", sha("1")), ("a/x.py", sha("2")), ("a/b/y.py", sha("3")), ("a/b/z.py", sha("4")), ("c/w.py", sha("5"))]
    found = {r["folder"]: (r["files"], r["sha256"]) for r in manifest.tree(spark.createDataFrame(rows, "path string, sha256 string")).collect()}
    ab = sha("\n".join(sorted([f"y.py:{sha('3')}", f"z.py:{sha('4')}"])))
    a = sha("\n".join(sorted([f"x.py:{sha('2')}", f"b/:{ab}"])))
    c = sha(f"w.py:{sha('5')}")
    assert found == {"a/b": (2, ab), "a": (3, a), "c": (1, c), "": (5, sha("\n".join(sorted([f"r.md:{sha('1')}", f"a/:{a}", f"c/:{c}"]))))}
    assert manifest.tree(spark.createDataFrame([], "path string, sha256 string")).count() == 0


def test_window_results_chain(spark):
    rows = [("w1", 5, 2, 9, 21, day("2018-01-02"), 110.0), ("w1", 5, 2, 9, 21, day("2018-01-03"), 99.0), ("w2", 6, 2, 9, 21, day("2019-01-02"), 120.0)]
    curves = spark.createDataFrame(rows, "window_id string, gap_period int, signal_period int, momentum_period int, vol_period int, date date, equity double")
    got = training.window_results(curves, 100.0).orderBy("first").collect()
    assert [(r["window_id"], r["start_equity"], r["end_equity"], round(r["return"], 6), round(r["max_drawdown"], 6)) for r in got] == [("w1", 100.0, 99.0, -0.01, -0.1), ("w2", 99.0, 120.0, 0.212121, 0.0)]
