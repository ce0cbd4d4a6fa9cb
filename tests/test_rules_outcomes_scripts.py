import io
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shipyard.operators import outcomes as O
from shipyard.operators import rules as R
from shipyard.operators import scripts as X
from shipyard.sources import files


def test_tablespace_check_and_messages(spark):
    cap = spark.createDataFrame([("MV2000_D", 30000.0), ("MV2000_I", 100.0)], "tablespace_name string, value double")
    chk = R.tablespace_check(cap)
    assert rows(chk, "tablespace_name", "status") == [
        ("MV2000_D", "ok"), ("MV2000_I", "undersized"), ("MV2000_L", "missing")]
    msg = R.tablespace_messages(chk).collect()[0]
    assert (msg.not_found, msg.wrong) == ("MV2000_L : 8192", "MV2000_I : 28672")
    assert msg.not_found_message == "As Tablespaces [MV2000_L : 8192] nao foram criadas!"
    assert msg.wrong_message == "As Tablespaces [MV2000_I : 28672] foram criadas com tamanho errado!"
    nulls = spark.createDataFrame([("MV2000_L", None)], "tablespace_name string, value double")
    assert rows(R.tablespace_check(nulls).where("tablespace_name = 'MV2000_L'"), "status") == [("undersized",)]


def test_privilege_gap_reports_first_missing(spark):
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user string")
    privs = spark.createDataFrame([("u2", "PACKAGE", "EXECUTE"), ("u3", "ROLE", "DBA"), ("u3", "PACKAGE", "X")],
                                  "user string, NAME string, VALUE string")
    gap = R.privilege_gap(users.withColumn("login", F.upper("user")), privs, ["user"], user_col="login")
    got = rows(gap, "user", "NAME", "reported", "message")
    assert got == [("u1", "PACKAGE", True, "Usuário logado [U1] não tem permissão na PACKAGE UTL_RECOMP"),
                   ("u1", "ROLE", False, "Usuário logado [U1] não tem permissão de DBA [DBA]"),
                   ("u2", "ROLE", True, "Usuário logado [U2] não tem permissão de DBA [DBA]")]


def test_disk_check_linux_and_windows(spark):
    nodes = spark.createDataFrame([
        ("lin", "LINUX", '{"/dev/a"=>{"kb_size"=>"1000", "kb_available"=>"400999"}, '
                         '"/dev/b"=>{"kb_size"=>"1000", "kb_available"=>"1"}, "tmp"=>{"kb_size"=>nil}}'),
        ("win", "WINDOWS", '{"C:"=>{"kb_size"=>"9", "kb_available"=>"999999"}, '
                           '"D:"=>{"kb_size"=>"1", "kb_available"=>"5000"}, "mvHome"=>"D:\\\\mv"}'),
        ("win2", "WINDOWS", '{"C:"=>{"kb_size"=>"9", "kb_available"=>"999999"}, "mvHome"=>"E:\\\\mv"}'),
    ], "server_host string, server_type string, attributes string")
    nodes = nodes.withColumn("drive", R.home_drive(nodes))
    dev = R.parse_filesystem(nodes, keys=["server_host"])
    out = R.disk_check(dev, ["server_host"], 100, type_col="server_type", drive_col="drive")
    got = rows(out, "server_host", "device", "free_mb", "passed", "_error")
    # ties on size: the smaller device name wins; kb / 1000 truncated
    assert got == [("lin", "/dev/a", 400, True, None), ("win", "D:", 5, False, None),
                   ("win2", None, None, False, "home drive not found: E:")]
    msgs = dict(rows(out, "server_host", "message"))
    assert msgs["lin"] is None
    assert msgs["win"] == ("Falha ao checar espaço em disco livre do servidor win / Causa Servidor sem espaço "
                           "em disco suficiente! Livre: 5 MB / Necessário: 100 MB")
    assert msgs["win2"].endswith("Causa MV_HOME [E:] não encontrada nos atributos do chef!")


def test_verdict_and_version_check(spark):
    res = spark.createDataFrame([("d1", "CHECK_AGENT_VERSION", True), ("d1", "CHECK_SERVERS_DISK_SPACE", False),
                                 ("d2", "CHECK_AGENT_VERSION", True), ("d3", "NOT_A_RULE", True)],
                                "msg_id string, rule string, passed boolean")
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "msg_id string")
    got = rows(R.validation_verdict(res, docs), "msg_id", "verdict", "_error")
    assert got == [("d1", False, None), ("d2", True, None), ("d3", True, "unknown validation rule"),
                   ("d4", True, None)]
    req = spark.createDataFrame([("c1", "1.2"), ("c2", "1.2"), ("c3", None)], "client_id string, metric string")
    ag = spark.createDataFrame([("c1", "1.2"), ("c2", "1.1")], "client_id string, agent_version string")
    vc = R.version_check(req, ag)
    assert rows(vc, "client_id", "passed") == [("c1", True), ("c2", False), ("c3", True)]
    assert rows(vc.where("NOT passed"), "message") == [
        ("Agente desatualizado! Versão do agente atual [1.1] / Versão do agente necessária 1.2 ",)]


def carry_loop(exits):
    last, out = None, []
    for e in exits:
        if e is not None:
            last = e
        out.append(last)
    return out


def test_phase_outcome_against_loop(spark):
    import random

    rnd = random.Random(5)
    data = [(m, p, rnd.choice([None, None, 0, 1, 2])) for m in range(30) for p in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(data, "msg_id int, phase_pos int, exit_status int") \
        .withColumn("phase_id", F.col("phase_pos").cast("string")).repartition(5)
    out = O.phase_outcome(df, order=["phase_pos"], status_error=F.lit("E"), status_complete=F.lit("C"))
    got = {(r.msg_id, r.phase_pos): (r.effective_exit, r.phase_status, r._error) for r in out.collect()}
    for m in range(30):
        seq = [e for (mm, p, e) in sorted(data) if mm == m]
        for p, eff in enumerate(carry_loop(seq)):
            st = None if eff is None else ("E" if eff != 0 else "C")
            err = "no earlier response to reuse" if eff is None else None
            assert got[(m, p)] == (eff, st, err)


def test_chunked_carry_forward_on_a_hot_key(spark):
    import random

    from shipyard.operators.scan import last_non_null

    rnd = random.Random(9)
    # one message holds most rows; it is cut into several range chunks
    data = [(0, p, rnd.choice([None, None, None, 1, 0])) for p in range(3000)]
    data += [(m, p, rnd.choice([None, 0, 1])) for m in range(1, 40) for p in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(data, "msg_id int, pos int, v int").repartition(7)
    got = {(r.msg_id, r.pos): r.eff for r in last_non_null(df, ["msg_id"], ["pos"], "v", "eff", chunks=16)
           .collect()}
    for m in {d[0] for d in data}:
        seq = [v for (mm, p, v) in sorted(data) if mm == m]
        assert [got[(m, p)] for p in range(len(seq))] == carry_loop(seq)


def test_fail_stop_against_loop(spark):
    import random

    rnd = random.Random(3)
    data = [(m, p, rnd.choice([0, 0, 0, 1])) for m in range(40) for p in range(rnd.randint(1, 8))]
    df = spark.createDataFrame(data, "msg_id int, pos int, exit_status int").repartition(6)
    kept = {(r.msg_id, r.pos) for r in O.fail_stop(df, order=["pos"]).collect()}
    want = set()
    for m in range(40):
        for (mm, p, e) in sorted(data):
            if mm != m:
                continue
            want.add((m, p))
            if e != 0:
                break
    assert kept == want


def test_replace_by_key_and_logs(spark):
    reg = spark.createDataFrame([("A", "A.1"), ("B", "B.1"), (None, "N.1")], "cd_produto string, ds_versao string")
    upd = spark.createDataFrame([("A", "A.2", 1), ("A", "A.3", 2), (None, "N.2", 1)],
                                "cd_produto string, ds_versao string, seq int")
    # a NULL key deletes nothing; of two updates of A the later wins
    out = O.replace_by_key(reg, upd, ["cd_produto"], update_order=["seq"])
    assert rows(out, "cd_produto", "ds_versao", "origin") == [
        ("A", "A.3", "new"), ("B", "B.1", "kept"), (None, "N.1", "kept"), (None, "N.2", "new")]
    logs = O.log_events(reg.withColumn("client_id", F.lit("c")).withColumn("execution_plan", F.lit("p")),
                        "WARN", F.struct("cd_produto"), logged_at="2024-01-01 00:00:00")
    r = logs.where("lo_conteudo like '%B%'").collect()[0]
    assert (r.cd_tipo_log, r.sn_sincronizado, r.ds_nivel, r.lo_conteudo) == (
        "plano.execucao", "S", "WARN", '{"cd_produto":"B"}')


def test_fingerprint_sides(spark):
    import hashlib

    art = spark.createDataFrame([("a", "hello"), ("b", "x"), ("c", "y")], "name string, content string")
    good = hashlib.md5(b"hello").hexdigest()
    exp = spark.createDataFrame([("a", good + "\nother"), ("b", "nope"), ("d", good)], "name string, md5_text string")
    got = rows(X.fingerprint_check(art, exp), "name", "ok")
    assert got == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_scan_script_packages(spark, tmp_path):
    def make_zip(path, entries):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            for name, data in entries.items():
                zf.writestr(name, data)
        path.write_bytes(buf.getvalue())

    d = tmp_path / "zips"
    d.mkdir()
    make_zip(d / "p1.zip", {"products/PROD/database/pre/001.sql": "select 'é'".encode("iso-8859-1"),
                            "products/PROD/database/pre/sub/002.sql": b"x",
                            "products/PROD/database/pos/003.sql": b"y",
                            "products/OTHER/database/pre/004.sql": b"z"})
    make_zip(d / "p2.zip", {"products/PROD/database/pre/001.sql": b"second"})
    pk = spark.createDataFrame([("m", "p1.zip", "PROD", "10", "1.0"), ("m", "p2.zip", "PROD", "11", "1.1")],
                               "msg_id string, filename string, productName string, scriptId string, version string")
    sc = X.scan_script_packages(spark, str(d / "*.zip"), pk)
    assert rows(sc, "filename", "name", "content") == [
        ("p1.zip", "001.sql", "select 'é'"), ("p1.zip", "sub/002.sql", "x"), ("p2.zip", "001.sql", "second")]
    assert rows(X.scripts_per_package(sc), "filename", "n_scripts") == [("p1.zip", 2), ("p2.zip", 1)]
    (d / "p3.zip").write_bytes(b"no zip")
    bad = spark.createDataFrame([("m", "p3.zip", "PROD", "12", "1.2"), ("m", "p1.zip", "PROD", "10", "1.0")], pk.schema)
    both = X.scan_script_packages(spark, str(d / "*.zip"), bad)
    assert rows(both.where("_error IS NOT NULL"), "filename", "name") == [("p3.zip", None)]
    assert rows(X.scripts_per_package(both), "filename", "n_scripts") == [("p1.zip", 2), ("p3.zip", 0)]


def test_snapshot_generations(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert files.load_snapshot(spark, path) is None
    a = spark.createDataFrame([("c1", "prod", "lb", 1)], "client_id string, environment string, balancer_host string, v int")
    files.save_snapshot(a, path, 1)
    files.save_snapshot(a.withColumn("v", F.lit(2)), path, 2)
    files.save_snapshot(a.withColumn("v", F.lit(2)), path, 2)  # a retry replaces its generation
    files.save_snapshot(a.withColumn("environment", F.lit("qa")), path, 1)
    files.save_snapshot(a.withColumn("client_id", F.lit("c2")).withColumn("environment", F.lit("dev")), path, 1)
    got = rows(files.load_snapshot(spark, path), "client_id", "environment", "v", "generation")
    assert got == [("c1", "prod", 2, 2), ("c1", "qa", 1, 1), ("c2", "dev", 1, 1)]
    assert rows(files.load_snapshot(spark, path, "PROD"), "v") == [(2,)]
    (tmp_path / "odd").mkdir()
    with pytest.raises(Exception):  # a folder without a schema is no missing snapshot
        files.load_snapshot(spark, str(tmp_path / "odd"))


def test_event_sink_is_idempotent(spark, tmp_path):
    rows_ = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        files.write_events(rows_, str(tmp_path / "ev"), 7)
    assert spark.read.text(str(tmp_path / "ev")).count() == 2


NODES = [("m", "lin", "LINUX", '{"/a"=>{"kb_size"=>"10", "kb_available"=>"99000"}, "/b"=>{"kb_size"=>"9", "kb_available"=>"1"}}'),
         ("m", "win", "WINDOWS", '{"C:"=>{"kb_size"=>"1", "kb_available"=>"1"}, "D:"=>{"kb_size"=>"5", "kb_available"=>"200000"}, "mvHome"=>"D:/x"}'),
         ("m", "nohome", "WINDOWS", '{"C:"=>{"kb_size"=>"1", "kb_available"=>"1"}, "mvHome"=>"E:/x"}'),
         ("m", "nil", "LINUX", '{"/a"=>{"kb_size"=>nil, "kb_available"=>"5"}}'),
         ("m", "text", "LINUX", '{"/a"=>{"kb_size"=>"12kB", "kb_available"=>"x"}}'),
         ("m", "null", "LINUX", None), ("m", "garbage", "LINUX", "no hash")]
NODE_COLS = "msg_id string, server_host string, server_type string, attributes string"


def test_every_node_is_judged(spark):
    nodes = spark.createDataFrame(NODES, NODE_COLS)
    nodes = nodes.withColumn("drive", R.home_drive(nodes))
    got = rows(R.disk_check(R.parse_filesystem(nodes), ["server_host"], 90, "server_type", "drive"),
               "server_host", "device", "free_mb", "passed", "_error")
    assert got == [("garbage", None, None, False, "no usable device"), ("lin", "/a", 99, True, None),
                   ("nil", None, None, False, "no usable device"), ("nohome", None, None, False, "home drive not found: E:"),
                   ("null", None, None, False, "no usable device"), ("text", None, None, False, "no usable device"),
                   ("win", "D:", 200, True, None)]


def test_run_rules(spark):
    """Every rule of a message, in one result shape; the tablespace rule only warns."""
    asked = [("m1", "c1", "prod", k, n, v) for k, (n, v) in enumerate([
        ("CHECK_AGENT_VERSION", "v1"), ("CHECK_SERVERS_DISK_SPACE", "90"), ("CHECK_DATABASE_CONNECTION", None),
        ("CHECK_DATABASE_TABLESPACE", None), ("CHECK_DATABASE_USER_MASTER", None)])]
    asked += [("m2", "c2", "prod", 0, "CHECK_AGENT_VERSION", "v9"), ("m2", "c2", "prod", 1, "CHECK_SERVERS_DISK_SPACE", "10"),
              ("m2", "c2", "prod", 2, "CHECK_DATABASE_CONNECTION", None), ("m2", "c2", "prod", 3, "CHECK_DATABASE_USER_MASTER", None),
              ("m3", "c1", "prod", 0, "CHECK_MOON", None)]
    rules = spark.createDataFrame(asked, "msg_id string, client_id string, environment string, rule_pos int, rule string, metric string")
    nodes = spark.createDataFrame([("m1", *n[1:]) for n in NODES[:2]] + [("m2", *NODES[5][1:])], NODE_COLS)
    seen = R.Observations(
        agents=spark.createDataFrame([("c1", "v1"), ("c2", "v1")], "client_id string, agent_version string"), nodes=nodes,
        connections=spark.createDataFrame([("c1", "prod", True)], "client_id string, environment string, connected boolean"),
        capacity=spark.createDataFrame([("c1", "prod", "MV2000_D", 1.0)],
                                       "client_id string, environment string, tablespace_name string, value double"),
        privileges=spark.createDataFrame([("c1", "prod", "PACKAGE"), ("c1", "prod", "ROLE"), ("c2", "prod", "ROLE")],
                                         "client_id string, environment string, NAME string"))
    out = R.run_rules(rules, seen)
    got = {(r.msg_id, r.rule): r.passed for r in out.collect()}
    assert got == {("m1", n): True for _, _, _, _, n, _ in asked[:5]} | {
        ("m2", "CHECK_AGENT_VERSION"): False, ("m2", "CHECK_SERVERS_DISK_SPACE"): False,
        ("m2", "CHECK_DATABASE_CONNECTION"): False, ("m2", "CHECK_DATABASE_USER_MASTER"): False, ("m3", "CHECK_MOON"): False}
    warned = [r.message for r in out.collect() if r.rule == "CHECK_DATABASE_TABLESPACE"]
    assert "MV2000_I : 28672" in warned[0] and "MV2000_D : 28672" in warned[0]
    verdict = rows(R.validation_verdict(out, rules.select("msg_id").distinct()), "msg_id", "verdict", "_error")
    assert verdict == [("m1", True, None), ("m2", False, None), ("m3", False, "unknown validation rule")]
    nothing = R.run_rules(rules.where("msg_id = 'm1'"), R.Observations())
    assert {r.message for r in nothing.collect()} == {"not observed"}


def test_statements_operator(spark):
    sc = spark.createDataFrame([(1, "a\n/\nb\n/\nc"), (2, "")], "script_id int, text string")
    assert rows(X.statements(sc)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
