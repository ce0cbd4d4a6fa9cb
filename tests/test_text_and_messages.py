import datetime as dt
import random

from conftest import rows
from shipyard.functions import codes, text
from shipyard.operators import messages as M

WS = "".join(chr(i) for i in range(33))


def split_loop(script):
    """The agent's loop, line by line (sequential oracle for F1)."""
    s = script.replace("\r\n", "\n").replace("\r", "\n")
    lines = s.split("\n") if s else []
    if s.endswith("\n"):
        lines = lines[:-1]
    stmts, buf = [], ""
    for line in lines:
        if line.strip(WS) == "/" and len(buf) != 0:
            stmts.append(buf)
            buf = ""
        else:
            if len(buf) != 0:
                buf += "\n"
            buf += line
    if not stmts:
        stmts.append(buf)
    return stmts


def _split(spark, scripts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scripts)], "id int, t string")
    got = {r.id: list(r.s) for r in df.select("id", text.split_statements("t").alias("s")).collect()}
    return [got[i] for i in range(len(scripts))]


def test_split_statements_edge_rules(spark):
    cases = {
        "a\n/\nb\n/": ["a", "b"],            # plain
        "select 1": ["select 1"],             # no "/" line: the whole buffer
        "/\nx\n/": ["/\nx"],                  # first line "/": text, buffer was empty
        "a\n/\n/\nb\n/": ["a", "/\nb"],       # two in a row: the second is text
        "\n\na\n/": ["a"],                    # empty lines first vanish
        "a\n/\ntail": ["a"],                  # text after the last "/" is dropped
        "": [""],                             # empty script
        "a\n \t/ \nb": ["a"],                 # Java trim: tabs and spaces around "/"
        "a\r\n/\r\nb\r/": ["a", "b"],         # CR LF and lone CR
        "a\n\n/\n": ["a\n"],                  # empty line inside a statement stays
    }
    got = _split(spark, list(cases))
    assert got == list(cases.values())
    assert got == [split_loop(s) for s in cases]


def test_split_statements_random_against_loop(spark):
    rnd = random.Random(11)
    toks = ["/", " / ", "\t/", "", " ", "select 1", "x", "/x", "//", "a b"]
    scripts = []
    for _ in range(400):
        sep = rnd.choice(["\n", "\r\n", "\r"])
        t = sep.join(rnd.choice(toks) for _ in range(rnd.randint(0, 14)))
        scripts.append(t + (sep if rnd.random() < 0.4 else ""))
    assert _split(spark, scripts) == [split_loop(s) for s in scripts]


def test_first_line_drive_and_masks(spark):
    df = spark.createDataFrame(
        [("abc\r\nx", "D:\\mv\\home", "run -P 'p.w*' x", "p.w*"), ("", None, "run -P 'q' x", None),
         ("h", "nocolon", "no pwd", "z")],
        "t string, home string, cmd string, pwd string")
    out = df.select(text.first_line("t").alias("f"), text.drive_of("home").alias("d"),
                    text.mask_password_arg("cmd", "pwd").alias("m")).collect()
    assert [tuple(r) for r in out] == [("abc", "D:", "run -P *** x"), (None, "C:", "run -P 'q' x"),
                                       ("h", "", "no pwd")]


def test_normalize_codes(spark):
    df = spark.createDataFrame(
        [("installation", "install", "linux", "chef"), ("Bootstrap", "INSTALL", "LiNuX", "agent"),
         (None, None, "win", None), ("unknown", "", None, "x"), ("nope", "download-install", "", "Agent")],
        "t string, c string, m string, p string")
    out = df.select(codes.message_type("t"), codes.command("c"), codes.machine_type("m"),
                    codes.phase_type("p")).collect()
    assert [tuple(r) for r in out] == [
        ("INSTALLATION", "INSTALL", "LINUX", "CHEF"),
        ("BOOTSTRAP", "UNKNOWN", "LINUX", "AGENT"),
        ("UNKNOWN", "UNKNOWN", "WINDOWS", "UNKNOWN"),
        ("UNKNOWN", "UNKNOWN", None, "UNKNOWN"),
        ("UNKNOWN", "DOWNLOAD_AND_INSTALL", "WINDOWS", "AGENT"),
    ]


def _msgs(spark, data):
    return spark.createDataFrame(data, "msg_seq long, client_id string, message_id string, checksum string, "
                                       "type_message string, arrival_ts timestamp")


def test_checksum_gate_is_null_safe(spark):
    t = dt.datetime(2024, 1, 1)
    msgs = _msgs(spark, [
        (1, "c1", "m1", None, "INSTALLATION", t),      # NULL checksum = NULL hash: passes
        (2, "c1", "m2", "h", "INSTALLATION", t),        # differs from NULL: rejected
        (3, "c2", "m3", "x", "BOOTSTRAP", t),           # wrong hash: rejected
        (4, "c2", "m4", "x", "CHECK_DATABASE", t),      # not gated
        (5, "c2", "m5", "h2", "BOOTSTRAP", t),          # right hash
        (6, "c9", "m6", "h2", "UPDATE_AGENT", t),       # unknown client
        (7, None, "m7", None, "UPDATE_AGENT", t),       # no client id
    ])
    clients = spark.createDataFrame([("c1", None), ("c2", "h2")], "client_id string, env_hash string")
    got = rows(M.accept_messages(msgs, clients), "msg_seq")
    assert got == [(1,), (4,), (5,)]
    assert rows(M.address_filter(msgs, clients), "msg_seq") == [(1,), (2,), (3,), (4,), (5,)]


def test_dedup_keeps_first_arrival_and_route(spark):
    t = dt.datetime(2024, 1, 1)
    msgs = _msgs(spark, [
        (3, "c", "m", "k", "INSTALLATION", t + dt.timedelta(seconds=5)),
        (1, "c", "m", "k", "INSTALLATION", t + dt.timedelta(seconds=9)),
        (2, "c", "m", "k", "BOOTSTRAP", t),
        (4, "c", "m2", "k", "UNKNOWN", t),
    ])
    dd = M.route(M.dedup_messages(msgs, order=("arrival_ts", "msg_seq")))
    assert rows(dd, "msg_seq", "route", "_error") == [
        (2, "BOOTSTRAP", None), (3, "INSTALLATION", None), (4, "UNKNOWN", "unknown message type")]
    # order independence: the same result on a reshuffled input
    dd2 = M.dedup_messages(msgs.repartition(7), order=("arrival_ts", "msg_seq"))
    assert rows(dd2, "msg_seq") == [(2,), (3,), (4,)]
