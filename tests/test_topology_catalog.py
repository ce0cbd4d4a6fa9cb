from conftest import rows
from shipyard.operators import catalog as C
from shipyard.operators import topology as TP

TOPO = ["balancer_host", "balancer_port", "server_host", "srv_pos", "port", "product_name", "product_type"]


def topo_inputs(spark):
    bal = spark.createDataFrame([("m", 0, "lb1", "80"), ("m", 1, "lb2", "80"), ("m", 2, "lb3", "81")],
                                "msg_id string, bal_pos int, balancer_host string, balancer_port string")
    srv = spark.createDataFrame([("m", 0, "h1"), ("m", 1, "h1"), ("m", 2, "h2")],
                                "msg_id string, srv_pos int, server_host string")
    ports = spark.createDataFrame([("m", 0, "8080"), ("m", 0, "8080"), ("m", 1, "8080"), ("m", 2, "9000")],
                                  "msg_id string, srv_pos int, port string")
    apps = spark.createDataFrame([
        ("m", 0, 0, "A", "soul-product-reports", "web", "8080", "lb1", "80"),   # reports context -> reports type
        ("m", 0, 1, "B", "ctx", None, "8080", "lb1", "80"),
        ("m", 1, 0, "C", "ctx", "web", "8080", "lb1", "80"),   # second entry of host h1: lost
        ("m", 2, 0, "D", "ctx", "web", "7000", "lb1", "80"),   # port not a server port: server without ports
        ("m", 2, 1, "E", "ctx", "web", "9000", "lb2", "80"),
    ], "msg_id string, srv_pos int, app_pos int, productname string, context string, type string, port string, "
       "balancer_host string, balancer_port string")
    return bal, srv, ports, apps


def test_balancer_topology_and_dedup(spark):
    t = TP.balancer_topology(*topo_inputs(spark))
    assert rows(t, *TOPO) == [
        ("lb1", "80", "h1", 0, "8080", "A", "reports"),
        ("lb1", "80", "h1", 0, "8080", "B", None),
        ("lb1", "80", "h2", 2, None, None, None),
        ("lb2", "80", "h2", 2, "9000", "E", "web"),
        ("lb3", "81", None, None, None, None, None),
    ]
    dl = spark.createDataFrame([("m", "DOWNLOAD")], "msg_id string, command string")
    assert TP.balancer_topology(*topo_inputs(spark), commands=dl).count() == 0


def test_merge_topology_precedence(spark):
    new = TP.balancer_topology(*topo_inputs(spark))
    cols = "msg_id string, bal_pos int, balancer_host string, balancer_port string, server_host string, " \
           "srv_pos int, port string, product_name string, product_context string, product_type string, app_pos int"
    old = spark.createDataFrame([
        ("m", 9, "lb1", "80", "h1", 5, "8080", "A", "c", "reports", 0),   # same (name, type): new wins
        ("m", 9, "lb1", "80", "h1", 5, "8080", "A", "c", "web", 1),       # other type: added
        ("m", 9, "lb1", "80", "h1", 5, "8080", "B", "c", None, 2),        # NULL type equal NULL: new wins
        ("m", 9, "lb1", "80", "h1", 5, "9999", "Z", "c", "web", 3),       # port missing now: added
        ("m", 9, "lb1", "80", "h2", 5, "1234", "Y", "c", "web", 4),       # h2 was bare: gains a port
        ("m", 9, "lb1", "80", "h9", 5, "1", "X", "c", "web", 5),          # server missing now: added
        ("m", 9, "lb3", "81", "h7", 5, "1", "W", "c", "web", 6),          # lb3 was empty: gains a server
        ("m", 9, "old", "80", "h1", 5, "1", "V", "c", "web", 7),          # balancer absent now: vanishes
    ], cols)
    merged = TP.merge_topology(new, old, keys=["msg_id"], order=["app_pos"])
    got = rows(merged, *TOPO[:3], "port", "product_name", "product_type", "origin", "returned")
    assert got == [
        ("lb1", "80", "h1", "8080", "A", "reports", "new", True),
        ("lb1", "80", "h1", "8080", "A", "web", "old", True),
        ("lb1", "80", "h1", "8080", "B", None, "new", True),
        ("lb1", "80", "h1", "9999", "Z", "web", "old", True),
        ("lb1", "80", "h2", "1234", "Y", "web", "old", True),
        ("lb1", "80", "h9", "1", "X", "web", "old", True),
        ("lb2", "80", "h2", "9000", "E", "web", "new", True),
        ("lb3", "81", "h7", "1", "W", "web", "old", True),
    ]
    # no snapshot: everything new is returned, empty balancers too
    assert TP.merge_topology(new, None, keys=["msg_id"]).where("returned").count() == new.count()


def test_not_in_is_null_aware(spark):
    left = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e1", None), ("e2", "a"), ("e3", None)],
                                 "env string, v string")
    right = spark.createDataFrame([("e1", "a"), ("e2", "x"), ("e2", None)], "env string, v string")
    got = rows(C.null_aware_not_in(left, right, ["env"], "v", "v"))
    # e1: b survives, NULL probe dropped (list not empty); e2: list has NULL -> empty; e3: empty list keeps NULL
    assert got == [("e1", "b"), ("e3", None)]
    lone = C.null_aware_not_in(left.where("env = 'e1'").drop("env"), right.where("env = 'e2'").drop("env"),
                               [], "v", "v")
    assert lone.count() == 0


def test_grant_gap_thresholds_and_duplicate_views(spark):
    objs = spark.createDataFrame([
        ("DBAMV", "V1", "VIEW"), ("DBAPS", "S1", "SEQUENCE"), ("DBASGU", "F1", "FUNCTION"),
        ("SYSTEM", "V2", "VIEW"), ("DBAMV", "X_BIN$1", "VIEW"), ("DBAMV", "T1", "TABLE")],
        "owner string, object_name string, object_type string")
    privs = spark.createDataFrame(
        [("DBAPS", "S1", g, "SELECT") for g in ["DBAMV", "DBASGU", "DBAPS", "MV2000"]]
        + [("DBASGU", "F1", g, "EXECUTE") for g in ["DBAMV", "DBAPS", "MVINTEGRA"]],
        "owner string, table_name string, grantee string, privilege string")
    got = rows(C.grant_gap(objs, privs), "object_name", "command")
    assert got == [
        ("F1", "GRANT EXECUTE ON DBASGU.F1 TO DBAMV,DBAPS,MVINTEGRA,MV2000"),
        ("V1", "GRANT SELECT,UPDATE,DELETE,INSERT ON DBAMV.V1 TO DBAPS,DBASGU,MVINTEGRA,MV2000"),
        ("V1", "GRANT SELECT,UPDATE,DELETE,INSERT ON DBAMV.V1 TO DBAPS,DBASGU,MVINTEGRA,MV2000"),
    ]
    assert C.grant_gap(objs, privs, dedupe=True).count() == 2


def test_fk_index_gap_minus_is_distinct_and_joins_without_owner(spark):
    cons = spark.createDataFrame([
        ("DBAMV", "T", "T_A_FK", "R", "A"), ("DBAMV", "T", "T_A2_FK", "R", "A"),
        ("DBASGU", "T", "T_B_FK", "R", "B"), ("DBAMV", "T", "T_C_FK", "R", "C"), ("DBAPS", "T", "T_D_FK", "R", "D"),
        ("DBAMV", "U", "U_P", "P", "A")],
        "owner string, table_name string, constraint_name string, constraint_type string, colunas string")
    idx = spark.createDataFrame([("DBAMV", "T", "I1", "C")], "owner string, table_name string, index_name string, "
                                                              "colunas string")
    got = rows(C.fk_index_gap(cons, idx), "owner", "constraint_name", "command")
    assert got == [
        ("DBAMV", "T_A2_FK", "create index DBAMV.T_A2_IX\n ON DBAMV.T(A) TABLESPACE MV2000_I COMPUTE STATISTICS"),
        ("DBAMV", "T_A_FK", "create index DBAMV.T_A_IX\n ON DBAMV.T(A) TABLESPACE MV2000_I COMPUTE STATISTICS"),
        ("DBASGU", "T_B_FK", "create index DBASGU.T_B_IX\n ON DBASGU.T(B) TABLESPACE MV2000_I COMPUTE STATISTICS"),
    ]


def test_column_list_and_audit_tail(spark):
    cols = spark.createDataFrame([("K", "B", 2), ("K", "A", 1), ("K", "C", 3), ("J", "X", 1)],
                                 "constraint_name string, column_name string, position int")
    assert rows(C.column_list(cols, ["constraint_name"])) == [("J", "X"), ("K", "A,B,C")]
    audit = spark.createDataFrame([(1, None), (2, 5), (3, 9), (4, 9)], "id int, timestamp int")
    assert [r.id for r in C.audit_tail(audit, n=3, id_col="id").collect()] == [1, 3, 4]


def test_tablespace_capacity_fans_out_temp_headers(spark):
    mb = 1024 * 1024
    data = spark.createDataFrame([(1, "MV2000_D", "/a", 10 * mb), (2, "MV2000_D", "/b", 5 * mb)],
                                 "file_id int, tablespace_name string, file_name string, maxbytes long")
    dview = spark.createDataFrame([("/a",)], "name string")
    free = spark.createDataFrame([(1, 100)], "file_id int, bytes long")
    temp = spark.createDataFrame([(7, "MV2000_L", 2 * mb), (8, "OTHER", mb)], "file_id int, tablespace_name string, "
                                                                               "maxbytes long")
    header = spark.createDataFrame([(7,), (7,)], "file_id int")
    tview = spark.createDataFrame([(7,), (8,)], "file_no int")
    cap = C.tablespace_capacity(data, dview, free, temp, header, tview, ["MV2000_D", "MV2000_L"])
    assert rows(cap) == [("MV2000_D", 10.0), ("MV2000_L", 4.0)]


def _nest(flat):
    """Flat topology rows -> {(key, bal_pos, host, port): {server: {port: [(name, type)]}}}."""
    out = {}
    for key, pos, host, port, server, sport, name, kind in flat:
        servers = out.setdefault((key, pos, host, port), {})
        if server is not None:
            ports = servers.setdefault(server, {})
            if sport is not None:
                ports.setdefault(sport, []).append((name, kind))
    return out


def _plain_merge(new, old):
    """The snapshot merged balancer by balancer, server by server, port by port."""
    new, old = _nest(new), _nest(old)
    for (key, pos, host, port), servers in new.items():
        for (okey, _, ohost, oport), oservers in old.items():
            if (okey, ohost, oport) != (key, host, port):
                continue
            had = {s: {p: list(v) for p, v in ports.items()} for s, ports in servers.items()}
            for server, oports in oservers.items():
                if server not in had:
                    servers[server] = {p: list(v) for p, v in oports.items()}
                    continue
                for sport, products in oports.items():
                    if sport not in had[server]:
                        servers[server][sport] = list(products)
                        continue
                    for product in products:
                        if product not in servers[server][sport]:
                            servers[server][sport].append(product)
    out = []
    for bal, servers in new.items():
        if not servers:
            out.append((*bal, None, None, None, None))
        for server, ports in servers.items():
            if not ports:
                out.append((*bal, server, None, None, None))
            for sport, products in ports.items():
                out += [(*bal, server, sport, *p) for p in products]
    return sorted(out, key=str)


def test_merge_follows_the_nested_loops(spark):
    """J4 against plain loops, with balancers that are listed twice, bare servers and empty balancers."""
    import random

    from shipyard.operators import topology as TP

    rng = random.Random(4)
    schema = ("environment string, bal_pos int, balancer_host string, balancer_port string, server_host string, port string, "
              "product_name string, product_type string, srv_pos int, app_pos int")

    def side(twice):
        flat = []
        for key in ("e1", "e2"):
            names = [("lb1", "80"), ("lb2", "80")] + ([("lb1", "80")] if twice else [])
            for pos, (host, port) in enumerate(names):
                servers = rng.sample(["h1", "h2", "h3"], rng.randint(0, 3))
                if not servers:
                    flat.append((key, pos, host, port, None, None, None, None))
                for server in servers:
                    ports = rng.sample(["1", "2", "3"], rng.randint(0, 3))
                    if not ports:
                        flat.append((key, pos, host, port, server, None, None, None))
                    for sport in ports:
                        for name in rng.sample(["A", "B", "C"], rng.randint(1, 3)):
                            flat.append((key, pos, host, port, server, sport, name, rng.choice(["x", None])))
        return flat

    for _ in range(3):
        new, old = side(True), side(False)
        frames = [spark.createDataFrame([(*r, 0, k) for k, r in enumerate(rows_)], schema) for rows_ in (new, old)]
        got = TP.merge_topology(*frames, order=["srv_pos", "app_pos"], materialize=False)
        cols = schema.split(", ")[:8]
        assert sorted((tuple(r) for r in got.select(*[c.split()[0] for c in cols]).collect()), key=str) == _plain_merge(new, old)


def test_topology_joins_its_lines_once(spark, tmp_path):
    import datetime

    from shipyard.plans import queries as Q
    from shipyard.plans import standins as SI

    early, late = datetime.datetime(1995, 1, 1), datetime.datetime(1999, 1, 1)
    tables = {
        "lineitem": ([(1, 1, 5, 7, "A", "O", late), (1, 2, 5, 7, "N", "F", late), (2, 1, 6, 8, "A", "O", early), (3, 1, None, 8, "R", "O", early),
                      (4, 1, 5, 9, "A", "O", early)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "supplier": ([(7, 1), (8, 1), (8, 1), (9, None)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, "N1")], "n_nationkey int, n_name string"),
        "part": ([(5, "B5", "PROMO"), (6, "B6", None)], "p_partkey long, p_brand string, p_type string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    for split in (None, "1998-01-01"):
        got, want = (SI.topology_inputs(spark, d, split_at=split, stored=s) for s in (True, False))
        for k, (x, y) in enumerate(zip(got, want)):
            assert x.columns == y.columns and rows(x) == rows(y) and x.count()
            if k in (0, 3):  # balancers and apps read the joined lines
                assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert rows(Q.q_topology_merge(spark, d), "server_host", "port", "product_name", "origin") == [
        ("h0", "1", "B5", "new"), ("h0", "1", "B6", "old"), ("h0", None, None, "new")]
