"""Installation flow over a table of installation messages, batch form.

    run_rules -> validation_verdict -> plan_phases -> first_products, expand_groups ->
    balancer_topology -> merge_topology -> steps -> fail_stop -> phase responses ->
    phase_outcome -> status_events / server_status_events / log rows -> registry rows

Recipes are not run here: their exit statuses are an input table (``outcomes``),
as they come back from the nodes. Every step is keyed by ``msg_id``, so one job
handles many messages for many clients.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import codes
from ..operators import chain as CH
from ..operators import documents as D
from ..operators import outcomes as O
from ..operators import rules as R
from ..operators import topology as TP
from ..operators.keyed import first_by
from ..operators.tables import materialize_table

STEP_KEY = ["msg_id", "phase_id", "srv_pos", "visit_pos", "entry_pos", "rec_pos"]
STEP_ORDER = ["phase_id", "plan_pos", "srv_pos", "visit_pos", "entry_pos", "rec_pos"]
APP_COLS = ["app_pos", "item_pos"]


class InstallationRun:
    """The outputs of a run; each is computed when it is first asked for.

    What several outputs read (the verdict, the messages that do not run, the steps that
    ran) is written once as a table; nothing is computed for outputs that are not read.
    """

    def __init__(self, docs: DataFrame, outcomes: DataFrame, results: DataFrame | None, snapshot: DataFrame | None,
                 created_at: str | None, observations: R.Observations | None, registries: DataFrame | None,
                 order: Sequence[str] | None) -> None:
        self._outcomes, self._results, self._snapshot, self._created_at = outcomes, results, snapshot, created_at
        self._observations, self._registries, self._order = observations or R.Observations(), registries, order
        self._docs = docs
        self._head = docs.select("msg_id", "client_id", "environment", "execution_plan", "command")
        self._bad = F.col("_corrupt").isNotNull() if "_corrupt" in docs.columns else F.col("doc").isNull()
        self._whole = docs.where(~self._bad)

    @cached_property
    def verdict(self) -> DataFrame:
        """msg_id, verdict, n_rules, n_failed (A2)."""
        results = self._results
        if results is None:
            results = R.run_rules(R.required_rules(self._whole), self._observations)
        return materialize_table(R.validation_verdict(results, self._whole.select("msg_id")))

    @cached_property
    def _good(self) -> DataFrame:
        return self.verdict.where(F.col("verdict") & F.col("_error").isNull()).select("msg_id")

    def _expanded(self, srv: DataFrame) -> DataFrame:
        return D.expand_groups(D.apps(srv), *D.dimension_tables())

    @cached_property
    def blocked(self) -> DataFrame:
        """msg_id, error: messages that do not run because of their body, rules or product groups."""
        corrupt = self._docs.where(self._bad).select("msg_id", F.lit("corrupt body").alias("error"))
        unknown = self.verdict.where(F.col("_error").isNotNull()).select("msg_id", F.col("_error").alias("error"))
        # The errors are looked for where the documents lie; only they meet the verdict.
        no_group = self._expanded(D.servers(self._whole)).where(F.col("_error").isNotNull()) \
            .groupBy("msg_id").agg(F.min("_error").alias("error")).join(self._good, "msg_id", "left_semi")
        return materialize_table(corrupt.unionByName(unknown).unionByName(no_group))

    @cached_property
    def _runs(self) -> DataFrame:
        """msg_id of the messages that run, written once: every output reads it. Whole documents do not meet it."""
        return materialize_table(self._good.join(self.blocked.select("msg_id"), "msg_id", "left_anti"))

    def _running(self, part: str) -> DataFrame:
        """One part of each document that runs; only that part travels."""
        return self._whole.select("msg_id", F.struct(F.col(f"doc.{part}").alias(part)).alias("doc")).join(self._runs, "msg_id", "left_semi")

    @cached_property
    def _servers(self) -> DataFrame:
        """Server entries where the documents lie, of messages that do not run as well: each reader joins them with what does."""
        return D.servers(self._whole)

    @cached_property
    def _products(self) -> DataFrame:
        """W1 products, before the expansion of groups, as ``_servers`` of all messages."""
        return D.first_products(D.apps(self._servers)).select(
            "msg_id", F.col("productname").alias("name"), "version", "itemVersion", "environment")

    @cached_property
    def phases(self) -> DataFrame:
        """Planned phases."""
        return D.plan_phases(D.phases(self._running("executionPlan")), D.run_entries(self._servers))

    @cached_property
    def _ran(self) -> DataFrame:
        """Steps: chef phases visit their servers; database phases run one script action; other
        phases (AGENT) run nothing and reuse the previous response."""
        p = self.phases.select("msg_id", F.col("id").alias("phase_id"), "plan_pos", "type", "statusComplete", "statusError")
        entries = D.run_entries(self._servers)
        db_phase = codes.is_database_action("statusComplete")
        chef = p.where((F.col("type") == "CHEF") & ~db_phase)
        visits = chef.join(entries.select("msg_id", "srv_pos", "server_host", F.col("id").alias("phase_id"),
                                          F.col("entry_pos").alias("visit_pos")), ["msg_id", "phase_id"])
        # A visit with no recipe to run makes the agent throw: exit 1 and no server row.
        chef_steps = D.steps(visits, entries).withColumn("throws", F.col("recipe").isNull()) \
            .withColumn("carried", F.lit(False))

        def single(rows: DataFrame, pos: int, recipe: str | None, carried: bool) -> DataFrame:
            return rows.select("*", *[F.lit(pos).alias(c) for c in ("srv_pos", "visit_pos", "entry_pos", "rec_pos")],
                               F.lit(None).cast("string").alias("server_host"), F.lit(recipe).cast("string")
                               .alias("recipe"), F.lit(False).alias("throws"), F.lit(carried).alias("carried"))

        db_steps = single(p.where(db_phase), -1, "database", False)
        active = chef_steps.unionByName(db_steps, allowMissingColumns=True)
        oc = self._outcomes.select(*STEP_KEY, F.col("exit_status").alias("_exit"))
        active = active.join(oc, [active[k].eqNullSafe(oc[k]) for k in STEP_KEY], "left").select(active["*"], "_exit") \
            .withColumn("exit_status", F.when(F.col("throws"), F.lit(1)).otherwise(F.col("_exit"))).drop("_exit")
        # W4 at step level: an idle phase takes the last response before it. As a run stops at its
        # first failure, that response is 0 if there is any; with none the agent fails.
        place = F.struct("phase_id", "plan_pos")
        answered = active.where(F.col("exit_status").isNotNull()).groupBy("msg_id").agg(F.min(place).alias("_first"))
        idle = single(p.where(~db_phase & (F.col("type") != "CHEF")), -2, None, True).join(answered, "msg_id", "left") \
            .withColumn("exit_status", F.when(F.col("_first") < place, F.lit(0)).otherwise(F.lit(1))).drop("_first")
        steps = active.unionByName(idle, allowMissingColumns=True) \
            .withColumn("silent", F.col("exit_status").isNull())
        # A step without an outcome stops the message as a failing one does.
        halts = steps.withColumn("_halt", F.coalesce("exit_status", F.lit(1)))
        ran = O.fail_stop(halts, order=STEP_ORDER, exit_col="_halt")
        ran = ran.withColumn("failed_here", F.coalesce(F.col("exit_status") != 0, F.lit(False)))
        return ran.withColumn("_error", F.when(F.col("silent"), F.lit(NO_OUTCOME))).drop("_halt")

    @cached_property
    def steps(self) -> DataFrame:
        """Steps that ran, with exit status (W3); _error where none was reported."""
        return materialize_table(self._ran)

    @cached_property
    def errors(self) -> DataFrame:
        """msg_id, error: messages that did not run, or not to their end."""
        ran = self.__dict__.get("steps", self._ran)
        return self.blocked.unionByName(ran.where("silent").select("msg_id", F.col("_error").alias("error")))

    @cached_property
    def _done(self) -> DataFrame:
        """The messages that ran to their end."""
        stopped = self.steps.where(F.col("failed_here") | F.col("silent")).select("msg_id").distinct()
        return self._head.join(self._runs, "msg_id", "left_semi").join(stopped, "msg_id", "left_anti")

    @cached_property
    def phase_results(self) -> DataFrame:
        """Completed phases with their effective exit (W4): every phase up to the one holding the
        first failure, but not one that waits for an outcome."""
        key = ["msg_id", "phase_id", "plan_pos"]
        waiting = self.steps.where("silent").select(*key)
        response = O.phase_response(self.steps, keys=key, order=["srv_pos", "visit_pos", "entry_pos", "rec_pos"])
        rows = self.phases.withColumnRenamed("id", "phase_id").join(response.select(*key, "exit_status"), key) \
            .join(waiting, key, "left_anti")
        # Every phase that ran has an exit by now, an idle one the one it took over.
        return O.phase_status(rows.withColumn("effective_exit", F.col("exit_status")))

    @cached_property
    def status_events(self) -> DataFrame:
        """Environment-item rows."""
        phases = self.phase_results.join(self._head.select("msg_id", "client_id", "execution_plan"), "msg_id") \
            .select("msg_id", "phase_id", "statusInitial", "statusComplete", "statusError", "initialProgress",
                    "finalProgress", "initialDescription", "finalDescription", "exit_status", "client_id", "execution_plan")
        return D.status_events(phases, self._products, created_at=self._created_at)

    @cached_property
    def server_events(self) -> DataFrame:
        """Server-item rows (J6): one per visit that ran its recipes; its response is the last step run."""
        ran = self.steps
        silent_visit = ran.where("silent").select("msg_id", "phase_id", "srv_pos", "visit_pos").distinct()
        response = first_by(ran.where(~F.col("throws") & (F.col("srv_pos") >= 0))
                            .join(silent_visit, ["msg_id", "phase_id", "srv_pos", "visit_pos"], "left_anti")
                            .select("msg_id", "phase_id", "srv_pos", "visit_pos", "entry_pos", "rec_pos",
                                    "exit_status", "statusComplete", "statusError"),
                            ["msg_id", "phase_id", "srv_pos", "visit_pos"], ["entry_pos", "rec_pos"], last=True)
        visits = response.join(self._head.select("msg_id", "client_id", "execution_plan"), "msg_id")
        return D.server_status_events(visits, D.apps(self._servers).drop("server_host"))

    @cached_property
    def logs(self) -> DataFrame:
        """Log rows (U3)."""
        return _logs(self.steps, self._head, self.verdict, self.errors, self._done, self._created_at)

    @cached_property
    def registry_updates(self) -> DataFrame:
        """U1 rows (msg_id, client_id, environment lead) of completed installs.

        The agent asks first whether the environment has the registry table (A5): with ``registries``
        only those environments get rows.
        """
        done = self._done.where(F.col("command").isin(*S.INSTALL_COMMANDS)).select("msg_id", "client_id", "environment")
        if self._registries is not None:
            have = self._registries.where("registry_exists").select("client_id", "environment")
            done = done.join(have, ["client_id", "environment"], "left_semi")
        finished = self._products.drop("environment").join(done, "msg_id")
        return O.registry_updates(finished, updated_at=self._created_at, keep=("msg_id", "client_id", "environment"))

    @cached_property
    def _where(self) -> DataFrame:
        more = [c for c in self._order or () if c not in self._head.columns]
        return self._docs.select("msg_id", "client_id", F.lower("environment").alias("environment"), "command", *more)

    @cached_property
    def _fresh(self) -> DataFrame:
        """J3 and W6 per (client, environment, message), without any snapshot."""
        expanded = self._expanded(self._servers).withColumn("item_pos", F.coalesce("item_pos", F.lit(0)))
        bal = self._running("listBalancer").select("msg_id", F.posexplode("doc.listBalancer").alias("bal_pos", "b")).select(
            "msg_id", "bal_pos", F.col("b.host").alias("balancer_host"), F.col("b.port").alias("balancer_port"))
        ports = self._servers.select("msg_id", "srv_pos", F.explode("ports").alias("port"))
        topo = TP.balancer_topology(bal, self._servers.select("msg_id", "srv_pos", "server_host"), ports, expanded,
                                    app_cols=APP_COLS, commands=self._head)
        return topo.join(self._where.select("msg_id", "client_id", "environment"), "msg_id")

    @cached_property
    def _stored(self) -> DataFrame | None:
        """The snapshot as the messages find it."""
        if self._snapshot is None:
            return None
        lacking = [c for c in CH.ENVIRONMENT if c not in self._snapshot.columns]
        if lacking:
            raise ValueError(f"the snapshot lacks {lacking}")
        old = self._snapshot.drop("msg_id", "origin", "returned", "generation", "seq")
        for c in APP_COLS:
            if c not in old.columns:
                old = old.withColumn(c, F.lit(0))
        return old

    @cached_property
    def _chain(self) -> DataFrame:
        if self._order is None:
            raise ValueError("the chain of snapshots needs the messages' order")
        rows = self._where.join(self._runs, "msg_id", "left_semi")
        return CH.message_chain(rows, order=self._order)

    @cached_property
    def _chained_rows(self) -> DataFrame:
        return materialize_table(self._fresh)

    @cached_property
    def topology_history(self) -> DataFrame:
        """J4 as a chain (``order`` given): each topology row and the messages whose snapshot holds it."""
        return materialize_table(CH.topology_history(self._chained_rows, self._chain, order=["srv_pos", *APP_COLS], stored=self._stored))

    @cached_property
    def topology(self) -> DataFrame:
        """Merged topology, flat, per client, environment and message.

        With ``order`` each message finds what the one before it left; without, all find ``snapshot``.
        """
        if self._order is not None:
            places = CH.balancer_places(self._chained_rows, self._chain)
            return CH.snapshots(self.topology_history, places, stored=self._stored).drop("seq")
        old = self._stored
        if old is not None:
            old = old.join(self._where.select("msg_id", "client_id", "environment"), ["client_id", "environment"])
        return TP.merge_topology(self._fresh, old, keys=["client_id", "environment", "msg_id"],
                                 order=["srv_pos", *APP_COLS], materialize=old is not None)

    @cached_property
    def snapshot(self) -> DataFrame:
        """What the last message of each environment leaves, to be stored; environments without a message keep theirs."""
        return CH.last_snapshot(self.topology_history, self._chain)

    @cached_property
    def balancers(self) -> DataFrame:
        """The balancers that stand on each server's own host, for installs."""
        returned = self.topology.where("returned").select("msg_id", "balancer_host", "balancer_port")
        servers = self._servers.select("msg_id", "srv_pos", "server_host").join(self._runs, "msg_id", "left_semi")
        return D.balancer_for_server(servers, returned, self._head)


def run_installation(docs: DataFrame, outcomes: DataFrame, results: DataFrame | None = None,
                     snapshot: DataFrame | None = None, created_at: str | None = None,
                     observations: R.Observations | None = None, registries: DataFrame | None = None,
                     order: Sequence[str] | None = None) -> InstallationRun:
    """Run the plan of each installation message against its step outcomes.

    ``docs``: msg_id, client_id, environment, execution_plan, command (normalised), doc
    and, as ``parse_body`` gives it, _corrupt.
    ``outcomes``: msg_id, phase_id, srv_pos, visit_pos, entry_pos, rec_pos, exit_status
    (database phases use srv_pos = visit_pos = entry_pos = rec_pos = -1).
    ``observations``: what the messages' own rules are judged on (``rules.run_rules``); a rule
    whose table was not observed fails. Or ``results``: ready validation results (msg_id,
    rule, passed). Only passing messages run.
    ``snapshot``: the stored topology (client_id and environment lead). Each message is
    merged with its own client's environment. ``order``: columns of ``docs`` by which an
    environment's messages follow each other, each one finding the snapshot that the one
    before left; without it the messages do not see each other's topology.
    ``registries``: client_id, environment, registry_exists (``catalog.registry_exists``).

    A message with a corrupt body, an unknown rule or an app without its product group
    does not run and is an error. A planned step without a reported outcome stops its
    message there: the message is an error, its phase is not completed, and nothing of
    it counts as success.
    """
    missing = [f.name for f in S.STEP_OUTCOME_SCHEMA.fields if f.name not in outcomes.columns]
    if missing:
        raise ValueError(f"outcomes lack columns {missing} (see schemas.STEP_OUTCOME_SCHEMA)")
    return InstallationRun(docs, outcomes, results, snapshot, created_at, observations, registries, order)


NO_OUTCOME = "no outcome reported"


def _text(template: str, recipe: F.Column) -> F.Column:
    """A fixed log text with ``{recipe}`` filled in."""
    before, _, after = template.partition("{recipe}")
    return F.concat(F.lit(before), recipe, F.lit(after))


def _logs(ran: DataFrame, head: DataFrame, verdict: DataFrame, errors: DataFrame, done: DataFrame,
          created_at: str | None) -> DataFrame:
    """Start and result of each step, then one row per message: finished, rejected or why it stopped.

    A step without an outcome leaves its start row only.
    """
    steps = ran.where(F.col("recipe").isNotNull()).join(head, "msg_id")
    command_text = F.lit(None).cast("string")
    for text, code in S.COMMANDS.items():
        command_text = F.when(F.col("command") == code, F.lit(text)).otherwise(command_text)
    prefix = F.concat(F.concat_ws(" | ", F.coalesce("server_host", F.lit("database")), "environment",
                                  F.coalesce(command_text, F.lit(""))), F.lit(" | "))
    recipe = F.col("recipe")

    def entry(level: str, text: F.Column) -> F.Column:
        return F.struct(F.lit(level).alias("_level"), text.alias("_t"))

    start = entry("INFO", F.concat(prefix, _text(S.LOG_RECIPE_START, recipe)))
    result = F.when(F.col("failed_here"), entry("ERROR", F.concat(prefix, _text(S.LOG_RECIPE_FAIL, recipe)))) \
        .when(~F.col("silent"), entry("INFO", F.concat(prefix, _text(S.LOG_RECIPE_OK, recipe))))
    who = ["client_id", "execution_plan"]
    rows = steps.select(*who, F.explode(F.filter(F.array(start, result), lambda e: e.isNotNull())).alias("_e")) \
        .select(*who, "_e.*")
    finished = done.select(*who, F.lit("INFO").alias("_level"), F.lit(S.LOG_DONE).alias("_t"))
    rejected = head.join(verdict.where("NOT verdict AND _error IS NULL").select("msg_id"), "msg_id", "left_semi") \
        .select(*who, F.lit("ERROR").alias("_level"), F.lit(S.LOG_REJECTED).alias("_t"))
    failed = head.join(errors, "msg_id").select(*who, F.lit("ERROR").alias("_level"), F.col("error").alias("_t"))
    rows = rows.unionByName(finished).unionByName(rejected).unionByName(failed)
    return O.log_events(rows, F.col("_level"), "_t", logged_at=created_at)
