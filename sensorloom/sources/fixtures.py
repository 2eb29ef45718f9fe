"""Derived views over the driver tables (DataFrame API).

Each view is a projection/filter of one or two base tables, so every
query built on them scans the whole given tables and its work grows with
them.  The DuckDB oracle rebuilds the same views from SQL text
(``plans/views_sql.py``); the two builds are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.elements import flatten_elements, preprocessing_flags
from .tables import Tables, dealt

SHELL_PREFIX = "https://example.com/ids/aas/0000_0000_0000_"
SUBMODEL_PREFIX = "https://example.com/ids/sm/0000_0000_"


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _padded(key, digits: int) -> Column:
    """At least ``digits`` digits; ``lpad`` alone would cut longer keys."""
    return F.lpad(_s(key), F.greatest(F.lit(digits), F.length(_s(key))), F.lit("0"))


def shell_iri(key) -> Column:
    return F.concat(F.lit(SHELL_PREFIX), _padded(key, 4))


def submodel_iri(key) -> Column:
    return F.concat(F.lit(SUBMODEL_PREFIX), _padded(key, 8))


class Fixtures(Tables):
    """Base tables plus the named views of FIXTURES.md section B."""

    # -- readings --------------------------------------------------------
    def readings(self) -> DataFrame:
        e = self.events
        eid = F.col("event_id")
        return e.select(
            eid.alias("offset_id"),
            F.when(eid % 5 == 0, F.lit(None).cast("string"))
             .when(eid % 5 == 1, "mqtt").otherwise("opcua").alias("source_type"),
            F.when(eid % 17 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("asset_"), _s("user_id"))).alias("asset_id"),
            _s("ts").alias("timestamp"),
            F.when(F.col("event_type") == "error", "bad")
             .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
             .otherwise("good").alias("quality"),
            F.when(eid % 11 == 0, F.lit(None).cast("string"))
             .when(eid % 7 == 0, "READY").when(eid % 13 == 0, "true")
             .otherwise(_s("value")).alias("value"),
            F.when(F.col("event_type") == "view", "deg").alias("unit"),
        )

    def raw_messages(self) -> DataFrame:
        r = self.readings()

        def q(c):
            return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))

        body = F.concat(
            F.lit('{"source_type":'), q("source_type"), F.lit(',"asset_id":'), q("asset_id"),
            F.lit(',"timestamp":"'), F.col("timestamp"), F.lit('","quality":'), q("quality"),
            F.lit(',"value":'),
            F.when(F.col("value").isNull(), "null").when(F.col("value") == "READY", '"READY"')
             .otherwise(F.col("value")),
            F.lit(',"unit":'), q("unit"), F.lit("}"))
        return r.select("offset_id", F.when(F.col("offset_id") % 19 == 0, '{"asset_id": broken')
                        .otherwise(body).alias("value"))

    def asset_trees(self) -> DataFrame:
        """The preprocessing submodel of each asset: four flags below collections."""
        n = F.expr("substring(asset_id, 7)").cast("int")
        steps = {"Cleansing": n % 2 == 0, "Imputation": n % 3 == 0, "Normalization": n % 5 != 0, "Transformation": n % 7 == 0}
        kids = [F.concat(F.lit('{"modelType":"SubmodelElementCollection","idShort":"' + name + '","value":[{"modelType":"Property",'
                               '"idShort":"Enabled","valueType":"xs:boolean","value":"'), on.cast("string"), F.lit('"}]}'))
                for name, on in steps.items()]
        js = F.concat(F.lit('[{"modelType":"SubmodelElementCollection","idShort":"PreProcessing","value":['),
                      F.concat_ws(",", *kids), F.lit("]}]"))
        assets = self.readings().where(F.col("asset_id").isNotNull()).select("asset_id").distinct()
        return assets.select("asset_id", js.alias("elements_json"))

    def asset_flags(self) -> DataFrame:
        """Step flags per asset, read from the element trees."""
        flat = flatten_elements(self.asset_trees(), key="asset_id", unroll=6)  # six arrays in a tree
        return preprocessing_flags(flat, key="asset_id").drop("review_needed")

    def modbus_polls(self) -> DataFrame:
        eid = F.col("event_id")
        return self.events.select("event_id", "ts", *[(eid % (100 - 9 * i)).alias(f"r{i}") for i in range(10)])

    # -- asset model -----------------------------------------------------
    def shells(self) -> DataFrame:
        return self.supplier.select(shell_iri("s_suppkey").alias("shell_id"),
                                    F.col("s_name").alias("id_short"), "s_suppkey")

    def submodel_refs(self) -> DataFrame:
        # Every tenth part is referenced by a key that no submodel has: the references dangle, the parts are orphans.
        k = F.col("l_partkey")
        # Numbers are made distinct, not their long texts: no two numbers have one text.
        pairs = self.lineitem.select("l_suppkey", F.when(k % 10 == 3, k + 50_000_000).otherwise(k).alias("_part"))
        pairs = pairs.repartition(self.tasks("lineitem"), "l_suppkey", "_part").distinct()
        return pairs.select(shell_iri("l_suppkey").alias("shell_id"), submodel_iri("_part").alias("submodel_id"))

    def submodels(self) -> DataFrame:
        return self.part.select(submodel_iri("p_partkey").alias("submodel_id"), F.col("p_type").alias("id_short"),
                                F.col("p_brand").alias("semantic_group"), F.col("p_retailprice").alias("price"))

    def change_log(self) -> DataFrame:
        k = F.col("o_orderkey") % 4
        return self.orders.select(
            F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
            F.when(k == 0, "create").when(k == 1, "replace").when(k == 2, "patch")
             .otherwise("delete").alias("op"),
            F.col("o_orderpriority").alias("body"))

    def element_trees(self, tasks: int | None = None) -> DataFrame:
        """With ``tasks`` the rows are dealt to so many by id (before their texts are built), else evenly."""
        k = F.col("p_partkey") % 3
        flag = F.when(k == 0, "true").when(k == 1, "false").otherwise("")
        js = F.concat(
            F.lit('[{"modelType":"SubmodelElementCollection","idShort":"Cleansing","value":'
                  '[{"modelType":"Property","idShort":"Enabled","valueType":"xs:boolean","value":"'),
            flag,
            F.lit('"}]},{"modelType":"Range","idShort":"Size","valueType":"xs:int","min":"0","max":"'),
            _s("p_size"),
            F.lit('"},{"modelType":"Property","idShort":"Brand","valueType":"xs:string","value":"'),
            F.col("p_brand"), F.lit('"}]'))
        if tasks is not None:
            return self.part.select(submodel_iri("p_partkey").alias("submodel_id"), "p_partkey", "p_size", "p_brand") \
                .repartition(tasks, "submodel_id").select("submodel_id", js.alias("elements_json"))
        return dealt(self.part.select("p_partkey", "p_size", "p_brand")).select(submodel_iri("p_partkey").alias("submodel_id"), js.alias("elements_json"))

    def stages(self) -> DataFrame:
        # Four template stages per pipeline; a literal array exploded per
        # supplier row (no cross join).
        tmpl = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("stage"),
                                  F.lit(nx).cast("string").alias("next"))
                         for r, s, nx in [(1, "Collection", "PreProcess"), (3, "PreProcess", "Storage"),
                                          (4, "Storage", "Utilization"), (6, "Utilization", None)]])
        n = F.col("s_suppkey")
        k = self.supplier.select(n, F.explode(tmpl).alias("k"))
        key = _s(n)
        return k.select(
            n.alias("pipeline_id"), F.col("k.rank").alias("rank"), F.col("k.stage").alias("stage"),
            F.concat(F.col("k.stage"), F.lit("_"), key).alias("component"),
            F.when((F.col("k.rank") == 3) & (n % 4 == 1), "mqtt").otherwise("opcua").alias("protocol"),
            F.when((n % 6 == 0) & (F.col("k.rank") == 3), F.concat(F.lit("Utilization_"), key))
             .when(F.col("k.rank") == 6, F.lit(None).cast("string"))
             .otherwise(F.concat(F.col("k.next"), F.lit("_"), key)).alias("aas_destination"))

    # -- node tree -------------------------------------------------------
    def nodes(self) -> DataFrame:
        nul = F.lit(None).cast("string")
        reg = self.region.select(nul.alias("parent_id"),
                                 F.concat(F.lit("ns=2;s=R"), _s("r_regionkey")).alias("node_id"),
                                 F.col("r_name").alias("name"), F.lit("Object").alias("node_class"),
                                 nul.alias("value"))
        nat = self.nation.select(F.concat(F.lit("ns=2;s=R"), _s("n_regionkey")),
                                 F.concat(F.lit("ns=2;s=N"), _s("n_nationkey")), "n_name",
                                 F.lit("Object"), nul)
        cus = self.customer.select(F.concat(F.lit("ns=2;s=N"), _s("c_nationkey")),
                                   F.concat(F.lit("ns=2;s=C"), _s("c_custkey")), "c_name",
                                   F.lit("Variable"), _s("c_acctbal"))
        return reg.unionAll(nat).unionAll(cus)

    # -- ops -------------------------------------------------------------
    def topics(self) -> DataFrame:
        s = self.supplier
        key = _s("s_suppkey")
        raw = s.select(F.concat(F.lit("opcua.s"), key, F.lit(".raw")).alias("topic"),
                       F.lit(1).alias("partitions"))
        proc = s.where(F.col("s_suppkey") % 3 != 0).select(
            F.concat(F.lit("opcua.s"), key, F.lit(".processed")), F.lit(1))
        internal = self.spark.createDataFrame([("__consumer_offsets", 50), ("agentic_ksql_log", 1)],
                                              "topic string, partitions int")
        return raw.unionAll(proc).unionAll(internal)

    def sinks(self) -> DataFrame:
        k = F.col("s_suppkey") % 4
        return (self.supplier.where(F.col("s_suppkey") % 3 != 0)
                .select(F.concat(F.lit("mongo-sink-opcua-s"), _s("s_suppkey"), F.lit("-processed"))
                        .alias("connector"),
                        F.when(k == 0, "FAILED").when(k == 1, "PAUSED").otherwise("RUNNING").alias("state")))

    # -- agent logs ------------------------------------------------------
    def tool_calls(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
                                  F.col("event_type").alias("tool"))

    def rpc_requests(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("method"),
                                  F.col("o_orderdate").alias("sent_at"))

    def rpc_responses(self) -> DataFrame:
        # an order is answered when its first line ships; a returned line makes the answer an error
        return self.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.min("l_shipdate").alias("recv_at"), F.when(F.max("l_returnflag") == "R", F.lit(-32601)).alias("error_code"))

    def reviews(self) -> DataFrame:
        def issue(severity, criterion):
            return f'{{"severity":"{severity}","criterion":"{criterion}","description":"d","fix":"f"}}'

        d = F.col("doc_id")
        unknown, none = d % 9 == 0, (d % 6 == 0) & (d % 9 != 0)
        first = F.when(unknown, issue("blocker", "security")).when(none, "").otherwise(issue("warning", "code_quality"))
        more = F.when((F.col("toxic") == 1) & ~none, "," + issue("critical", "security")).otherwise("")
        body = F.concat(F.lit('{"approved":'), F.when(F.col("quality") == 1, "true").otherwise("false"),
                        F.lit(',"summary":"s","issues":['), first, more, F.lit("]}"))
        return self.labels.select(d.alias("review_id"), F.when(d % 13 == 0, "no review").when(d % 17 == 0, '{"approved":true,"issues":[]}')
                                  .otherwise(body).alias("body"))

    def plans(self) -> DataFrame:
        # plans with all fields, and such with a missing field or one of another type
        d = F.col("doc_id")
        body = F.concat(
            F.lit('{"technology_lower":'), F.when(d % 17 == 0, "null").otherwise(F.concat(F.lit('"t'), _s(d), F.lit('"'))),
            F.lit(',"technology_pascal":"T'), _s(d), F.lit('","default_port":'), F.when(d % 11 == 0, '"abc"').otherwise("8000"),
            F.lit(',"server_instructions":"s"'),
            F.when(d % 7 == 0, "").when(d % 13 == 0, ',"tools":"read"').otherwise(',"tools":[{"name":"read"}]'),
            F.lit(',"clarification_questions":['), F.when(F.col("quality") == 0, '"q"').otherwise(""), F.lit("]}"))
        return self.labels.select("doc_id", F.when(d % 5 == 0, "not json").otherwise(body).alias("body"))

    def token_deltas(self) -> DataFrame:
        words = self.conversations.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"),
                                          F.posexplode(F.split(F.col("text"), " ", -1)).alias("seq", "w"))
        return words.select("message_id", "seq", F.concat("w", F.lit(" ")).alias("delta"))

    def audit_calls(self) -> DataFrame:
        k = F.col("o_orderkey") % 3
        return self.orders.select(
            F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("seq"),
            F.when(k == 0, "generate_mcp_server").when(k == 1, "review_code").otherwise("clarify").alias("tool"),
            F.when(k == 1, F.col("o_orderstatus") == "F").alias("approved"))

    # -- search ----------------------------------------------------------
    def hits(self) -> DataFrame:
        pid = F.col("page_id")
        return self.pages.select(
            F.floor(pid / 20).alias("query_id"), pid.alias("pos"),
            F.when(pid % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("url")).alias("title"),
            F.when(pid % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("html")).alias("snippet"),
            F.when(pid % 6 == 0, F.lit(None).cast("string")).when(pid % 6 == 1, F.concat(F.lit("ftp:"), F.col("url"))).otherwise(F.col("url")).alias("url"),
            F.when(pid % 4 == 0, F.lit(None).cast("double")).when(pid % 4 == 1, F.lit(0.0))
             .otherwise(pid.cast("double") / 1024).alias("score"))
