"""Queries over what the sinks write and the readers read again, over guards, and over calls to judges."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agreement, caveats, guards, journal, kept_tally, manifest, records, reliability, score
from ..sources import judge, producer, readers, sinks, slate
from ..sources.fixtures import table, view
from ..sources.shared import shared_dir
from ..streaming import tail, twins
from .catalog import ORACLES, query, tallied


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _renamed(spark: SparkSession, folder: str, ending: str) -> str:
    """Part files of a folder with another ending."""
    fs, p = readers._fs(spark, folder)
    for i, s in enumerate(x for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")):
        fs.rename(s.getPath(), readers._fs(spark, f"{folder}/{i}{ending}")[1])
    return folder


def _written(spark: SparkSession, whole: str) -> str:
    """A short text as one file."""
    folder = _folder(spark)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(folder)
    return folder


@query("select backend, pair_id, run_index, verdict, reason, model_id, prompt_version, temperature, base_url, cached_tokens from votes ")
def votes_on_disk(spark, sf_dir):
    """Appended run by run, read strictly."""
    folder = _folder(spark)
    rows = view(spark, sf_dir, "votes").withColumns({"run_index": F.col("run_index").cast("long"), "usage": F.when(F.col("cached_tokens").isNotNull(), F.struct(*[F.lit(None).cast("long").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")], "cached_tokens", F.lit(None).cast("long").alias("reasoning_tokens")))})
    for run in range(3):
        sinks.append_votes(rows.where(F.col("run_index") == run), folder)
    names = ["backend", "pair_id", "run_index", "verdict", "reason", "model_id", "prompt_version", "temperature", "base_url", "cached_tokens"]
    return readers.read_votes(spark, folder).select(*names)


def _grown(spark, whole: str, folder: str, share: float) -> None:
    """Files of `folder` as a writer leaves them that is stopped at this share of the bytes of those in `whole`; a task for each file at a time."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(whole).select("path", "length")

    def copy(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, source = files.FileSystem.from_uri(path)
                target = files.FileSystem.from_uri(folder)[1] + source[source.index(mark) + len(mark) :]
                fresh, left = f"{target[: target.rindex('/')]}/_{uuid.uuid4().hex}", int(size * share)
                fs.create_dir(target[: target.rindex("/")], recursive=True)
                with fs.open_input_stream(source) as f, fs.open_output_stream(fresh) as out:
                    while left > 0:
                        block = f.read(min(left, 1 << 20))
                        out.write(block)
                        left -= len(block)
                fs.move(fresh, target)
            yield batch

    mark = f"/{whole.rstrip('/').rsplit('/', 1)[1]}"
    listed.repartition(8, "path").mapInArrow(copy, listed.schema).write.format("noop").mode("overwrite").save()


@query("select backend, pair_id, run_index, verdict, reason, model_id, prompt_version, temperature, base_url, cached_tokens from votes ")
def tailed_votes(spark, sf_dir):
    """Result files read while they grow, with writers that stop anywhere in a line, by a query that starts again each time."""
    whole, folder = _folder(spark), _folder(spark)
    rows = view(spark, sf_dir, "votes").withColumns({"run_index": F.col("run_index").cast("long"), "usage": F.when(F.col("cached_tokens").isNotNull(), F.struct(*[F.lit(None).cast("long").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")], "cached_tokens", F.lit(None).cast("long").alias("reasoning_tokens")))})
    sinks.append_votes(rows, whole)
    names = ["backend", "pair_id", "run_index", "verdict", "reason", "model_id", "prompt_version", "temperature", "base_url", "cached_tokens"]
    parts = []
    for share in (0.37, 0.71, 1.0):
        _grown(spark, whole, folder, share)
        parts.append(twins.run_to_end(spark, tail.tail_votes(spark, folder, ".json").select(*names), "append", f"{folder}-places"))
    return parts[0].union(parts[1]).union(parts[2])


@query()
def kept_tally_votes(spark, sf_dir):
    """Votes added run by run, a batch repeated, the counters folded before the last run comes."""
    folder, votes = _folder(spark), view(spark, sf_dir, "votes")
    for run in (0, 1, 1, 2):
        if run == 2:
            kept_tally.fold(spark, folder)
        kept_tally.add_votes(votes.where(F.col("run_index") == run), folder, run)
    kept_tally.add_votes(votes.where("run_index > 2"), folder, 3)
    names = ("verdict_flip_rate", "reason_flip_rate")
    return kept_tally.read_tally(spark, folder).select("backend", "pair_id", "n_votes", "verdict", "reason", *[F.round(n, 6).alias(n) for n in names])


ORACLES["kept_tally_votes"] = ORACLES["tally_votes"]


@query("select v.backend from (select distinct backend from votes) v")
def roster_on_disk(spark, sf_dir):
    folder = _folder(spark)
    sinks.append_votes(view(spark, sf_dir, "votes"), folder)
    return readers.roster(spark, folder)


@query("select pair_id, verdict, reason, model_id from votes where cast(substr(pair_id, 2) as bigint) % 7 not in (0, 1)")
def tolerant_votes(spark, sf_dir):
    """Torn lines and lines without a reason are passed over, in folders below; keys that are not known are ignored."""
    v = view(spark, sf_dir, "votes")
    n = F.substring("pair_id", 2, 20).cast("long") % 7
    whole = F.to_json(F.struct("pair_id", "verdict", F.when(n != 1, F.col("reason")).alias("reason"), "model_id", F.when(n == 2, F.lit("x")).alias("more")))
    folder = _folder(spark)
    v.select(F.when(n == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("value")).write.text(f"{folder}/a/b")
    _renamed(spark, f"{folder}/a/b", ".jsonl")
    return readers.read_votes_tolerant(spark, folder)


def _pairs_file(spark, sf_dir) -> str:
    folder = _folder(spark)
    sinks.pair_lines(view(spark, sf_dir, "pairs")).orderBy("pos").select("value").write.text(folder)
    return folder


@query("select id, original, enriched, brand, mpn, ground_truth, reason, row_number() over (order by pos) - 1 as pos from pairs p")
def pairs_on_disk(spark, sf_dir):
    return readers.read_pairs(spark, _pairs_file(spark, sf_dir))


@query("select id as pair_id, row_number() over (order by pos) - 1 as rank from pairs p")
def pair_order(spark, sf_dir):
    return readers.pair_order(spark, _pairs_file(spark, sf_dir))


@query("""select row_number() over (order by o_orderkey % 2 desc, o_orderkey) - 1 as seq, 's' as session, 'p' || o_custkey as pair_id, case o_orderstatus when 'F' then 'rule' when 'O' then 'skip' else 'undo' end as action,
 case when o_orderstatus = 'F' then 'approve' end as ground_truth, case when o_orderstatus = 'F' then 'ok' end as reason, o_orderkey * 10 as elapsed_ms from orders""")
def journal_on_disk(spark, sf_dir):
    """Two appends, of which the second goes on where the first ends."""
    status = F.col("o_orderstatus")
    action = F.when(status == "F", "rule").when(status == "O", "skip").otherwise("undo")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("at"), F.lit("s").alias("session"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("pair_id"), action.alias("action"),
        F.when(status == "F", "approve").alias("ground_truth"), F.when(status == "F", "ok").alias("reason"), (F.col("o_orderkey") * 10).cast("long").alias("elapsed_ms"),
    )
    folder = _folder(spark)
    for odd in (1, 0):
        sinks.append_journal(rows.where(F.col("at") % 2 == odd), folder, "at")
    return readers.read_journal(spark, folder).select("seq", "session", "pair_id", "action", "ground_truth", "reason", "elapsed_ms")


@query("""with rows as (select p_partkey, 'e10-' || substr(sha256(p_name || chr(0) || p_type), 1, 12) as id, p_name, p_type, 'size ' || p_size % 3 as cohort, 'size ' || p_size as source, p_brand from part),
 known as (select id, max_by(case when p_partkey % 3 = 0 then '' else p_brand end, p_partkey) as brand, max_by(case when p_partkey % 2 = 0 then source else '' end, p_partkey) as mpn from rows where p_partkey % 5 > 0 group by id)
 select rows.id, cohort, '{"id":' || to_json(rows.id) || ',"original":' || to_json(p_name) || ',"enriched":' || to_json(p_type) || ',"cohort":' || to_json(cohort) || ',"source":' || to_json(source) || ',"stages":["' || p_brand || '","x"],"ground_truth":null,"reason":null'
  || case when brand <> '' then ',"brand":' || to_json(brand) else '' end || case when mpn <> '' then ',"mpn":' || to_json(mpn) else '' end || '}' as value from rows left join known on known.id = rows.id""")
def template_lines(spark, sf_dir):
    part, source = table(spark, sf_dir, "part"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    rows = part.select(F.col("p_name").alias("before"), F.col("p_type").alias("after"), F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string")).alias("cohort"), source.alias("source"), F.array("p_brand", F.lit("x")).alias("stages"))
    n = F.col("p_partkey")
    extra = part.where("p_partkey % 5 > 0").select(text.row_id(F.col("p_name"), F.col("p_type")).alias("id"), F.when(n % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.when(n % 2 == 0, source).otherwise("").alias("mpn"), n.alias("pos"))
    return sinks.template(rows, extra)


@query()
def deadlock_lines(spark, sf_dir):
    return sinks.deadlock_lines(agreement.deadlocks(tallied(spark, sf_dir), "s1"))


ORACLES["deadlock_lines"] = f"""select '{{"backend":"' || backend || '","kind":"' || kind || '","leg":"' || leg || '","n_votes":' || n_votes || ',"pair_id":"' || pair_id || '","record_version":1,"split":"' || split || '"}}' as value from ({ORACLES["backend_deadlocks"]}) d"""


@query("select id, ground_truth, reason from pairs p where pos % 4 > 0")
def rulings_export(spark, sf_dir):
    folder = _folder(spark)
    sinks.export_rulings(view(spark, sf_dir, "pairs").where("pos % 4 > 0").withColumnRenamed("id", "pair_id"), folder)
    return readers.read_jsonl(spark, folder, "id string, ground_truth string, reason string")


@query("""with o as (select count(*) as n from pairs p where pos % 10 = 0), f as (select string_agg(id, ', ' order by pos) as ids from (select id, pos from pairs p where pos % 10 = 0 order by pos limit 3)), z as (select min(id) as id from pairs p)
 select 'unruled pairs' as guard, n || ' pairs have no ruling, first: ' || ids as message from o, f
 union all select 'no known pair', 'no vote is of a pair with ground truth'
 union all select 'other configuration', (select count(*) from votes where backend <> 'm0') || ' rows were judged under another configuration'
 union all select 'no provenance', (select count(*) from votes where backend = 'm0') || ' rows lack provenance and no manifest supplies it'
 union all select 'ruling of an unknown row', 'rulings of unknown rows: ' || id from z
 union all select 'row without a ruling', 'rows without a ruling: ' || id from z
 union all select 'no key', 'no key for: y'
 union all select 'no https', 'backend y: base_url must be https'
 union all select 'too many names', '40 names for 29 keys'""")
def guard_messages(spark, sf_dir):
    """What each guard says when it refuses."""
    pairs, votes = view(spark, sf_dir, "pairs"), _with_config(view(spark, sf_dir, "votes"))
    one = pairs.agg(F.min("id").alias("id"))
    blank = pairs.withColumns({"ground_truth": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}).select("id", "ground_truth", "reason")
    rulings = pairs.select("id", "ground_truth", "reason")
    run = {"model_id": "model-m0", "prompt_version": "v3"}
    backend = {"name": "y", "base_url": "https://y.example", "model_id": "m", "rpm": 60, "eval_only": False}
    checks = {
        "unruled pairs": lambda: guards.require_ruled(pairs.withColumn("ground_truth", F.when(F.col("pos") % 10 > 0, F.col("ground_truth")))),
        "no known pair": lambda: score.known_votes(votes.withColumn("pair_id", F.lit("none")), pairs),
        "other configuration": lambda: guards.resume_keys(votes, run),
        "no provenance": lambda: guards.resume_keys(votes.where("backend = 'm0'"), run | {"code_version": "abc"}),
        "ruling of an unknown row": lambda: journal.merge_rulings(blank.join(one, "id", "left_anti"), rulings),
        "row without a ruling": lambda: journal.merge_rulings(blank, rulings.join(one, "id", "left_anti")),
        "no key": lambda: slate.with_keys(spark.createDataFrame([readers._backend(backend)], readers.SLATE), {}),
        "no https": lambda: readers._backend(backend | {"base_url": "http://y.example"}),
        "too many names": lambda: records.allocate_keys([str(i) for i in range(40)]),
    }
    said = []
    for name, check in checks.items():
        try:
            check()
        except guards.GuardError as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "guard string, message string")


def _with_config(votes: DataFrame) -> DataFrame:
    return votes.withColumns({c: F.lit(None).cast("string") for c in ("reasoning_effort", "config_digest", "code_version")})


@query("select distinct pair_id, run_index from votes where backend = 'm1'")
def resume_keys(spark, sf_dir):
    """Every vote appended twice, as after a launch that was cut off; the manifest's host settles rows without one."""
    votes = _with_config(view(spark, sf_dir, "votes").where("backend = 'm1'")).withColumn("base_url", F.when(F.col("run_index") > 0, F.col("base_url")))
    host = "https://api.alpha.example/v1"
    return guards.resume_keys(votes.unionByName(votes), {"model_id": "model-m1", "prompt_version": "v3", "base_url": host}, manifest_host=host)


@query("""select p_partkey as n, coalesce(case when p_partkey % 5 > 0 then p_brand end = case when p_partkey % 7 = 0 then 'other' else p_brand end, true) and coalesce(p_type = case when p_partkey % 3 > 0 then (select min(p_type) from part) end, true) as same from part""")
def same_run(spark, sf_dir):
    n = F.col("p_partkey")
    before = F.struct(F.when(n % 5 > 0, F.col("p_brand")).alias("model_id"), F.col("p_type").alias("base_url"))
    now = F.struct(F.when(n % 7 == 0, "other").otherwise(F.col("p_brand")).alias("model_id"), F.when(n % 3 > 0, F.col("least")).alias("base_url"))
    part = table(spark, sf_dir, "part")
    rows = part.join(part.agg(F.min("p_type").alias("least"))).select(n.alias("n"), before.alias("before"), now.alias("now"))
    return rows.select("n", reliability.same_run("before", "now", ("model_id", "base_url")).alias("same"))


def _launched(spark, sf_dir) -> DataFrame:
    """Manifests of a launch of the odd calls, after one of the even calls; of m1 that was another model, so its history does not count."""
    calls = view(spark, sf_dir, "calls").withColumn("launch", F.col("event_id") % 2)
    runs = calls.select(F.col("backend").alias("name")).distinct().withColumn("model_id", F.concat(F.lit("model-"), F.col("name")))
    runs = runs.withColumn("base_url", F.when(F.col("name") != "m2", F.concat(F.lit("https://"), F.col("name"), F.lit(".example"))))
    before = F.struct(F.when(F.col("name") == "m1", "older").otherwise(F.col("model_id")).alias("model_id"), F.concat(F.lit("https://"), F.col("name"), F.lit(".example")).alias("base_url"))
    first = manifest.health(calls.where("launch = 0")).join(runs.select(F.col("name").alias("backend"), before.alias("identity")), "backend")
    previous = first.select("backend", "identity", F.array("health").alias("launches"))
    return manifest.run_manifest(runs, calls.where("launch = 1"), view(spark, sf_dir, "pairs"), previous, {"votes": 3, "prompt_version": text.PROMPT_VERSION})


LAUNCHED = """n as (select backend, count(*) filter (ok = 1 and event_id % 2 = 1) as ok1, count(*) filter (ok = 0 and event_id % 2 = 1) as bad1, count(*) filter (ok = 1 and event_id % 2 = 0 and backend <> 'm1') as ok0, count(*) filter (ok = 0 and event_id % 2 = 0 and backend <> 'm1') as bad0 from calls group by backend)"""


@query(f"""with {LAUNCHED}, k as (select backend, string_agg(error_kind || '=' || c, ',' order by error_kind) as kinds from (select backend, error_kind, count(*) as c from calls where ok = 0 and (event_id % 2 = 1 or backend <> 'm1') group by all) group by backend),
 v as (select string_agg(variant || '=' || c, ',' order by variant) as variants, sum(c) :: bigint as n_pairs from (select case when brand <> '' and mpn <> '' then 'brand+mpn' when brand <> '' then 'brand' when mpn <> '' then 'mpn' else 'none' end as variant, count(*) as c from pairs group by 1))
 select n.backend, 'model-' || n.backend as model_id, 3 as votes, 'v3' as prompt_version, n_pairs, variants, ok1 as calls_ok, bad1 as calls_failed, case when n.backend = 'm1' then 1 else 2 end as launches, ok1 + ok0 as all_ok, bad1 + bad0 as all_failed, coalesce(kinds, '') as all_kinds, case when n.backend = 'm1' then 1 else 0 end as discarded from n join v on true left join k on k.backend = n.backend""")
def manifests_on_disk(spark, sf_dir):
    """Written, written again in place, and read."""
    folder, runs = _folder(spark), _launched(spark, sf_dir)
    sinks.write_manifests(runs.withColumn("votes", F.lit(1)), folder)
    sinks.write_manifests(runs, folder)
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    m = readers.read_manifests(spark, folder)
    return m.select(
        "backend", "model_id", "votes", "prompt_version", "n_pairs", shown("prompt_variants").alias("variants"), F.col("health.calls_ok").alias("calls_ok"), F.col("health.calls_failed").alias("calls_failed"), F.col("cumulative.launches").alias("launches"),
        F.col("cumulative.calls_ok").alias("all_ok"), F.col("cumulative.calls_failed").alias("all_failed"), F.coalesce(shown("cumulative.error_kinds"), F.lit("")).alias("all_kinds"), F.col("cumulative.discarded_prior_launches").alias("discarded"),
    )


@query("select (select count(*) from pairs ) as n_pairs, 'm2' as beside, 0 as beside_none")
def manifest_lookups(spark, sf_dir):
    """The largest number of pairs of any manifest, and the manifest beside a results file."""
    folder = _folder(spark)
    sinks.write_manifests(_launched(spark, sf_dir), folder)
    most = readers.read_manifests(spark, folder).agg(caveats.manifest_pairs(None).alias("n_pairs"))
    beside = readers.manifest_beside(spark, f"{folder}/m2.jsonl").agg(F.max("backend").alias("beside"))
    none = readers.manifest_beside(spark, f"{folder}/zz.jsonl").agg(F.count("*").alias("beside_none"))
    return most.join(beside).join(none)  # a row each


def _nations(spark, sf_dir) -> list[dict]:
    """A slate with one backend for each nation, of which there are always 25."""
    out = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():
        k, b = r["n_nationkey"], {"name": r["n_name"].lower().replace(" ", "-"), "base_url": f"https://n{r['n_nationkey'] % 4}.example/v1/", "model_id": f"model {r['n_name']}", "rpm": 10 + r["n_nationkey"], "eval_only": r["n_nationkey"] % 2 == 0}
        extra = {"api": "anthropic" if k % 3 == 0 else None, "temperature": 0.5 if k % 4 == 1 else None, "reasoning_effort": "low" if k % 5 == 2 else None, "structured_output": True if k % 2 else None, "role": "floor" if k == 7 else None, "api_key_env": "SHARED_KEY" if k == 3 else None}
        out.append(b | {n: v for n, v in extra.items() if v is not None})
    return out


NATIONS = """nations as (select n_nationkey as k, lower(replace(n_name, ' ', '-')) as name, 'https://n' || (n_nationkey % 4) || '.example/v1' as base_url, 'model ' || n_name as model_id, case when n_nationkey % 3 = 0 then 'anthropic' else 'openai' end as api,
 case when n_nationkey % 4 = 1 then 0.5 end as temperature, case when n_nationkey % 5 = 2 then 'low' end as reasoning_effort, n_nationkey % 2 = 1 as structured_output, case when n_nationkey = 3 then 'SHARED_KEY' else upper(replace(n_name, ' ', '_')) || '_API_KEY' end as api_key_env from nation)"""


def _slate(spark, sf_dir) -> DataFrame:
    toml = "\n".join("[[backends]]\n" + "\n".join(f"{n} = {json.dumps(v)}" for n, v in b.items()) for b in _nations(spark, sf_dir))
    return readers.read_slate(spark, _written(spark, toml))


@query(f"with {NATIONS} select name, base_url, model_id, 10 + k as rpm, k % 2 = 0 as eval_only, api_key_env, api, case when k = 7 then 'floor' else 'contender' end as role, cast(180 as double) as timeout_s, cast(temperature as double) as temperature, reasoning_effort, structured_output from nations")
def slate_on_disk(spark, sf_dir):
    return _slate(spark, sf_dir)


@query(f"""with {NATIONS}, c as (select *, k % 3 <> 1 and api_key_env <> 'SHARED_KEY' as has_key from nations)
 select name, has_key, has_key as runs, case when has_key then 'ok   ' || name else 'FAIL ' || name || ': ' || api_key_env || ' is not set' end as line, case when k % 4 = 0 then 'ok   ' || name when k % 4 = 1 then 'FAIL ' || name || ': status 503: down' else 'FAIL ' || name || ': TimeoutError' end as ping from c""")
def slate_checks(spark, sf_dir):
    """Keys of two nations in three are set; of four hosts one answers, one is down and two are silent."""
    backends = _slate(spark, sf_dir)
    env = {r["api_key_env"]: "k" for r in backends.where("(rpm - 10) % 3 <> 1").collect() if r["api_key_env"] != "SHARED_KEY"}

    def answer(backend: dict, body: str) -> tuple[int, str]:
        host = int(backend["base_url"][len("https://n")])
        if host > 1:
            raise TimeoutError
        return (503, "down") if host else (200, "{}")

    keys, pings = slate.check_keys(backends, env), slate.ping(backends, answer)
    kept = {r["name"] for r in slate.with_keys(backends, env, keep_going=True)[0].collect()}
    rows = [(c.name, c.ok, c.name in kept, line, ping) for c, line, ping in zip(keys, slate.render(keys).splitlines(), slate.render(pings).splitlines(), strict=True)]
    return spark.createDataFrame(rows, "name string, has_key boolean, runs boolean, line string, ping string")


@query(f"""with {NATIONS} select name, substr(sha256('{{"api":"' || api || '","base_url":"' || base_url || '","model_id":"' || model_id || '","prompt_version":"v3","reasoning_effort":' || coalesce('"' || reasoning_effort || '"', 'null') || ',"structured_output":' || case when structured_output then 'true' else 'false' end || ',"temperature":' || coalesce(cast(temperature as varchar), 'null') || '}}'), 1, 12) as digest from nations""")
def backend_digests(spark, sf_dir):
    rows = [(r["name"], text.backend_digest(r.asDict())) for r in _slate(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "name string, digest string")


def echo(backend: dict, body: str) -> tuple[int, str]:
    """A judge that goes by the number of characters of what it is asked: some calls fail, some replies break the contract."""
    asked = json.loads(body)
    n = len(asked["messages"][-1]["content"])
    if n % 7 == 0:
        raise TimeoutError
    if n % 7 == 1:
        return 500, "down"
    ruling = '{"verdict": "approve", "reason": "ok"}' if n % 2 else '{"verdict": "reject", "reason": "casing_error"}'
    reply = f"{'no idea' if n % 7 == 2 else ruling} of {backend['path']} by {','.join(sorted(asked))}"
    return 200, json.dumps({"content": [{"type": "text", "text": reply}]} if backend["api"] == "anthropic" else {"choices": [{"message": {"content": reply}}]})


def _runs(spark) -> DataFrame:
    fast = {"rpm": 60_000_000, "eval_only": False, "model_id": "m"}
    backends = [
        {"name": "a", "base_url": "https://one.example/v1", "temperature": 0.5, "structured_output": True},
        {"name": "b", "base_url": "https://two.example/v1", "api": "anthropic", "reasoning_effort": "none"},
        {"name": "c", "base_url": "https://two.example/v1", "api": "anthropic", "reasoning_effort": "low", "structured_output": True},
    ]
    return spark.createDataFrame([readers._backend(b | fast) for b in backends], readers.SLATE)


def _todo(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pairs").select(F.col("id").alias("pair_id"), F.lit(0).alias("run_index"), "original", "enriched", "brand", "mpn", "pos")


#: Tasks that a host's calls are dealt to; they keep its one rate.
LANES = 12


def _log(spark, sf_dir) -> DataFrame:
    keeping = judge.Keeping(None, None, f"{_folder(spark)}/bars")
    return judge.judge(_todo(spark, sf_dir), _runs(spark), echo, concurrency=4, keeping=keeping, lanes=LANES)


LOG = """asked as (select id as pair_id, length(case when brand <> '' then 'BRAND: ' || brand || chr(10) else '' end || case when mpn <> '' then 'MPN: ' || mpn || chr(10) else '' end || 'ORIGINAL: ' || original || chr(10) || 'ENRICHED: ' || enriched) as n from pairs ),
 runs as (select 'a' as backend, '/chat/completions by messages,model,response_format,temperature' as told union all select 'b', '/messages by max_tokens,messages,model,system,thinking' union all select 'c', '/messages by max_tokens,messages,model,output_config,system')"""


@query(f"""with {LOG} select backend, pair_id, 0 as run_index, case when n % 7 > 1 then 1 else 0 end as ok, case when n % 7 = 1 then 500 when n % 7 > 1 then 200 end as status, case when n % 7 = 0 then 'TimeoutError' when n % 7 = 1 then 'HTTPStatusError' end as error_kind,
 case when n % 7 > 1 then case when n % 7 = 2 then 'no idea' when n % 2 = 1 then '{{"verdict": "approve", "reason": "ok"}}' else '{{"verdict": "reject", "reason": "casing_error"}}' end || ' of ' || told end as reply from asked, runs""")
def judge_calls(spark, sf_dir):
    """One call for each pair and backend, of two dialects on two hosts."""
    return _log(spark, sf_dir).drop("latency_s")


@query(f"with {LOG} select backend, pair_id, 0 as run_index, case when n % 2 = 1 then 'approve' else 'reject' end as verdict, case when n % 2 = 1 then 'ok' else 'casing_error' end as reason from asked, runs where n % 7 > 2")
def judge_verdicts(spark, sf_dir):
    return judge.verdicts(_log(spark, sf_dir))


@query(f"""with {LOG} select backend, pair_id, 0 as run_index, cast(case when n % 7 > 1 then 1 else 0 end as bigint) as answers, cast(case when n % 7 > 1 then 0 when backend = 'b' then 1 else 2 end as bigint) as failures,
 cast(case when backend = 'b' then 1 else 0 end as bigint) as held from asked, runs""")
def judge_resumed(spark, sf_dir):
    """Two launches by the durable producer, the first with a backend held: the second asks only for what has no answer."""
    folder, runs = _folder(spark), _runs(spark)
    producer.hold(spark, folder, "b")
    for launch in range(2):
        if launch:
            producer.release(spark, folder, "b")
        producer.enqueue(_todo(spark, sf_dir), runs, folder, batch=100_000)
        if failed := producer.run(runs, echo, folder, concurrency=4, lanes=LANES):
            raise RuntimeError(str(failed))
    held = F.col("error_kind").eqNullSafe("Held")
    return producer.read_log(spark, folder).groupBy(*producer.KEYS).agg(F.count_if(F.col("ok") == 1).alias("answers"), F.count_if((F.col("ok") == 0) & ~held).alias("failures"), F.count_if(held).alias("held"))


def digest(settings: dict, body: str) -> tuple[int, str]:
    """A judge that replies with the digest of all that it is asked."""
    whole = json.dumps(json.loads(body), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    reply = hashlib.sha256(whole.encode()).hexdigest()
    return 200, json.dumps({"content": [{"type": "text", "text": reply}]} if settings["api"] == "anthropic" else {"choices": [{"message": {"content": reply}}]})


BODIES = """with told as (select id as pair_id, concat_ws(' and ', case when brand <> '' then 'BRAND' end, case when mpn <> '' then 'MPN (manufacturer part number)' end) as known,
  case when brand <> '' then 'BRAND: ' || brand || chr(10) else '' end || case when mpn <> '' then 'MPN: ' || mpn || chr(10) else '' end || 'ORIGINAL: ' || original || chr(10) || 'ENRICHED: ' || enriched as u from pairs),
 said as (select pair_id, to_json('$INPUTS' || case when known <> '' then ',' || chr(10) || 'plus the product''s known ' || known else '' end || '.' || chr(10) || '$CRITERIA') as s, to_json(u) as u from told),
 schema as (select '{"additionalProperties":false,"properties":{"reason":{"enum":["ok","casing_error","overcorrection","meaning_change"],"type":"string"},"verdict":{"enum":["approve","reject"],"type":"string"}},"required":["verdict","reason"],"type":"object"}' as schema),
 asked as (select 'a' as backend, pair_id, '{"messages":[{"content":' || s || ',"role":"system"},{"content":' || u || ',"role":"user"}],"model":"m","response_format":{"json_schema":{"name":"judge_verdict","schema":' || schema || ',"strict":true},"type":"json_schema"},"temperature":0.5}' as body from said, schema
  union all select 'b', pair_id, '{"max_tokens":256,"messages":[{"content":' || u || ',"role":"user"}],"model":"m","system":' || s || ',"thinking":{"type":"disabled"}}' from said
  union all select 'c', pair_id, '{"max_tokens":256,"messages":[{"content":' || u || ',"role":"user"}],"model":"m","output_config":{"effort":"low","format":{"schema":' || schema || ',"type":"json_schema"}},"system":' || s || '}' from said, schema)
 select backend, pair_id, 0 as run_index, 1 as ok, sha256(body) as reply from asked""".replace("$INPUTS", text.INTRO + text.INPUTS).replace("$CRITERIA", text.CRITERIA)


@query(BODIES)
def judge_in_lanes(spark, sf_dir):
    """Each host's calls from several tasks that keep its one rate; replies are digests of whole bodies, prompts and schema included."""
    keeping = judge.Keeping(f"{_folder(spark)}/answers", None, f"{_folder(spark)}/bars")
    log = judge.judge(_todo(spark, sf_dir), _runs(spark), digest, concurrency=4, keeping=keeping, lanes=LANES)
    return log.select("backend", "pair_id", "run_index", "ok", "reply")


@query("select 'rule' as action, id as pair_id, ground_truth, reason, null :: varchar as notes, pos % 2 = 0 as auto, pos * 7 as elapsed_ms, true as stamped from pairs p union all select 'skip', id, null, null, null, false, null, true from pairs p union all select 'note', id, null, null, original, false, null, true from pairs p union all select 'undo', null, null, null, null, false, null, true")
def journal_records(spark, sf_dir):
    p, s = view(spark, sf_dir, "pairs"), F.lit("s")
    ruled = records.rule(s, F.col("id"), F.col("ground_truth"), F.col("reason"), auto=F.col("pos") % 2 == 0, elapsed_ms=F.col("pos") * 7)
    made = [p.select(ruled.alias("r")), p.select(records.skip(s, F.col("id")).alias("r")), p.select(records.note(s, F.col("id"), F.col("original")).alias("r")), spark.range(1).select(records.undo(s).alias("r"))]
    rows = made[0].union(made[1]).union(made[2]).union(made[3]).select("r.*")
    return rows.select("action", "pair_id", "ground_truth", "reason", "notes", "auto", "elapsed_ms", F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


@query("select t.*, (select count(*) from votes v where v.reason = t.reason) as votes from (values (false, '1', 'ok'), (false, '2', 'casing_error'), (false, '3', 'overcorrection'), (false, '4', 'meaning_change'), (true, '1', 'casing_error'), (true, '2', 'overcorrection'), (true, '3', 'meaning_change')) t(reject_only, key, reason)")
def reason_keys(spark, sf_dir):
    rows = [(only, k, r) for only in (False, True) for k, r in records.reason_keys(only).items()]
    given = view(spark, sf_dir, "votes").groupBy("reason").agg(F.count("*").alias("votes"))
    keys = spark.createDataFrame(rows, "reject_only boolean, key string, reason string").join(given, "reason", "left")
    return keys.select("reject_only", "key", "reason", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


@query("select distinct backend, pair_id, run_index, verdict, reason from votes ")
def stream_dedupe(spark, sf_dir):
    """Every vote streamed twice is kept once."""
    folder, votes = _folder(spark), view(spark, sf_dir, "votes").select("backend", "pair_id", F.col("run_index").cast("long").alias("run_index"), "verdict", "reason")
    for _ in range(2):
        votes.repartition(2).write.mode("append").json(folder)
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 2).json(folder)
    return twins.run_to_end(spark, twins.stream_dedupe(stream), "append").select(*votes.columns)
