"""Records at the edges: projections, rules with violations, manifests, gates of a model's output.

Rules give rows for what breaks them and never stop a job; what is null breaks a
rule unless its docstring says otherwise. Empty tables break nothing.
"""

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import first_reason, fresh_name, normal_text, stripped
from tessella.operators.ranges import running
from tessella.operators.validation import CONTROLS, SHA256

# Limits of a model's answer, of requests, and of pictures.
RISKS = ("LOW", "MEDIUM", "HIGH")
ANSWER_FIELDS = ("capture_issues", "cross_view_observations", "limitations", "observations", "ood_risk")
MOST_TEXT, MOST_LISTED, MOST_OBSERVATIONS, MOST_ISSUES = 500, 32, 64, 16
MOST_IDS, MOST_TOP_K, LEAST_FRAMES, MOST_FRAMES_SENT, LONGEST_MS = 5, 10, 3, 24, 86_400_000
LEAST_SIDE = 32
PICTURE_TYPES = ("image/jpeg", "image/png", "image/webp")
ANSWER = (
    "struct<observations:array<struct<capture_id:string,view_code:string,text:string>>,cross_view_observations:array<string>,limitations:array<string>,"
    "capture_issues:array<struct<capture_id:string,issue:string>>,ood_risk:string>"
)


def project(df: DataFrame, tree: dict) -> DataFrame:
    """Only the fields that ``tree`` names: name -> source column, or name -> tree of a nested struct; all others are left out.

    A nested struct whose fields are all null is kept as such.
    """

    def column(spec) -> Column:
        if isinstance(spec, dict):
            return F.struct(*[column(s).alias(n) for n, s in spec.items()])
        return spec if isinstance(spec, Column) else F.col(spec)

    return df.select(*[column(spec).alias(name) for name, spec in tree.items()])


def json_strings(text: Column) -> Column:
    """All strings that stand as values, at any depth, in a JSON text, in order; names of fields are none. No JSON: none."""

    def walk(value, out: list[str]) -> None:
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, dict):
            for item in value.values():
                walk(item, out)
        elif isinstance(value, list):
            for item in value:
                walk(item, out)

    def run(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            out: list[str] = []
            try:
                walk(json.loads(text), out) if text else None
            except (ValueError, RecursionError):
                out = []
            rows.append(out)
        return pa.array(rows, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def canonical_json(fields: Column) -> Column:
    """A map of strings as JSON, names in order, nulls kept, without blanks."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})


def _strict(text: str | None):
    """The value of a JSON text; ValueError for none, for no JSON and for numbers that JSON doesn't have."""

    def odd(name: str):
        raise ValueError(name)

    return json.loads(text if text is not None else "", parse_constant=odd)


def _written(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_text(text: Column) -> Column:
    """A JSON text of any shape in its canonical form, null where it is none.

    Fields stand in order of their names at every depth, the last of equal names
    holds; there are no blanks; whole numbers keep all their digits, others are
    written as the shortest decimals that give the same number; only quotes,
    backslashes and control characters are escaped.
    """

    def run(column: pa.Array) -> pa.Array:
        out = []
        for one in column.to_pylist():
            try:
                out.append(_written(_strict(one)))
            except (ValueError, RecursionError, OverflowError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def with_appended(text: Column, path: list[str], item: Column) -> Column:
    """A JSON object with ``item``, a JSON text, at the end of the list that ``path`` names, in canonical form.

    Objects and the list that the path lacks are made. Null where a text is no
    JSON, or something else stands on the path.
    """

    def run(column: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for one, more in zip(column.to_pylist(), items.to_pylist()):
            try:
                whole, at = _strict(one), None
                inner = whole
                for name in path[:-1]:
                    inner = inner.setdefault(name, {})
                at = inner.setdefault(path[-1], [])
                at.append(_strict(more))
                out.append(_written(whole))
            except (ValueError, AttributeError, TypeError, RecursionError, OverflowError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, item)


def answer_violations(answers: DataFrame, captures: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(answer_id, rule) for what is wrong with a model's structured answers.

    ``answers``: answer_id, body (JSON). ``captures``: answer_id, capture_id,
    view_code, those the model was shown. A body has exactly the known fields, and
    so has each observation and issue, all of them strings; texts are non-blank,
    whatever the script of the blanks, and bounded, those of observations and
    issues with their blanks; lists are bounded and without repeats; an observation
    or issue names a shown capture, with its view; every shown capture has one. No
    string matches a ``forbidden`` pattern once it is in normal form.
    """
    a = answers.select(
        "answer_id", F.try_parse_json("body").alias("v"), F.from_json("body", ANSWER).alias("a"), F.array_sort(F.json_object_keys("body")).alias("fields"), json_strings(F.col("body")).alias("said")
    )
    strings = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")).isin("ARRAY<VOID>", "ARRAY<STRING>")
    shaped = lambda name, *fields: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")).isin(
        "ARRAY<VOID>", f"ARRAY<OBJECT<{', '.join(f'{f}: STRING' for f in sorted(fields))}>>"
    )
    listed = lambda name: ~F.exists(F.col(f"a.{name}"), lambda t: ~F.coalesce(F.length(stripped(t)).between(1, MOST_TEXT), F.lit(False)))
    bound = lambda t: F.coalesce((stripped(t) != "") & (F.length(t) <= MOST_TEXT), F.lit(False))
    unique = lambda name: F.size(f"a.{name}") == F.size(F.array_distinct(f"a.{name}"))
    refused = lambda t: reduce(Column.__or__, [normal_text(t).rlike(p) for p in forbidden], F.lit(False))
    rules = {
        "fields": F.col("fields") == F.array(*map(F.lit, ANSWER_FIELDS)),
        "ood_risk": F.col("a.ood_risk").isin(*RISKS),
        **{f"{n}_texts": strings(n) & listed(n) for n in ("cross_view_observations", "limitations")},
        **{f"{n}_bounded": F.size(f"a.{n}") <= MOST_LISTED for n in ("cross_view_observations", "limitations")},
        **{f"{n}_unique": unique(n) for n in ("cross_view_observations", "limitations")},
        "observation_fields": shaped("observations", "capture_id", "view_code", "text"),
        "observations_bounded": F.size("a.observations") <= MOST_OBSERVATIONS,
        "observation_texts": F.forall("a.observations", lambda o: bound(o["text"])),
        "capture_issue_fields": shaped("capture_issues", "capture_id", "issue"),
        "capture_issues_bounded": F.size("a.capture_issues") <= MOST_ISSUES,
        "capture_issue_texts": F.forall("a.capture_issues", lambda i: bound(i["issue"])),
        "guard": ~F.exists("said", refused),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    own = a.select("answer_id", F.explode(broken).alias("rule"))
    seen = F.transform("a.observations", lambda o: F.struct(o["capture_id"].alias("capture_id"), o["view_code"].alias("view_code"), F.lit(True).alias("view")))
    issues = F.transform("a.capture_issues", lambda i: F.struct(i["capture_id"].alias("capture_id"), F.lit(None).cast("string").alias("view_code"), F.lit(False).alias("view")))
    named = a.select("answer_id", F.explode(F.concat(F.coalesce(seen, F.array().cast("array<struct<capture_id:string,view_code:string,view:boolean>>")), F.coalesce(issues, F.array().cast("array<struct<capture_id:string,view_code:string,view:boolean>>")))).alias("n")).select("answer_id", "n.*")
    shown = captures.select("answer_id", "capture_id", F.col("view_code").alias("shown_as")).distinct()
    met = named.join(shown, ["answer_id", "capture_id"], "left")
    unbound = met.where(F.col("shown_as").isNull() | (F.col("view") & ~F.col("view_code").eqNullSafe(F.col("shown_as"))))
    unbound = unbound.select("answer_id", F.when(F.col("view"), "observation_not_bound").otherwise("capture_issue_not_bound").alias("rule")).distinct()
    missing = shown.join(named.select("answer_id", "capture_id").distinct(), ["answer_id", "capture_id"], "left_anti")
    missing = missing.join(answers.select("answer_id"), "answer_id", "left_semi").select("answer_id", F.lit("capture_not_represented").alias("rule")).distinct()
    return own.unionByName(unbound).unionByName(missing)


def citation_violations(reports: DataFrame, allowed: DataFrame) -> DataFrame:
    """(report_id, rule, citation_id): citations that are blank, repeated in a report, or not among those allowed it.

    ``reports``: report_id, citation_ids (array). ``allowed``: report_id, citation_id.
    """
    cited = reports.select("report_id", F.explode("citation_ids").alias("citation_id"))
    counted = cited.groupBy("report_id", "citation_id").agg(F.count(F.lit(1)).alias("n"))
    known = allowed.select("report_id", "citation_id").distinct().withColumn("known", F.lit(True))
    joined = counted.join(known, ["report_id", "citation_id"], "left")
    blank = F.coalesce(F.col("citation_id"), F.lit("")) == ""
    rules = F.array_compact(F.array(F.when(blank, "BLANK"), F.when(~blank & (F.col("n") > 1), "REPEATED"), F.when(~blank & F.col("known").isNull(), "NOT_ALLOWED")))
    return joined.select("report_id", F.explode(rules).alias("rule"), F.coalesce("citation_id", F.lit("")).alias("citation_id"))


def recognition_request_rules() -> dict[str, Column]:
    """Bounds of a recognition request: ids (array), top_k."""
    ids = F.transform("ids", lambda i: F.trim(i))
    return {
        "id_count": F.size("ids").between(1, MOST_IDS),
        "ids_not_blank": ~F.exists(ids, lambda i: F.coalesce(i == "", F.lit(True))),
        "ids_unique": F.size(F.array_distinct(ids)) == F.size("ids"),
        "top_k": F.col("top_k").between(1, MOST_TOP_K),
    }


def timeline_rules() -> dict[str, Column]:
    """Bounds of a request with video frames: duration_ms, timestamps (array)."""
    return {
        "duration": F.col("duration_ms").between(1, LONGEST_MS),
        "frame_count": F.size("timestamps").between(LEAST_FRAMES, MOST_FRAMES_SENT),
        "timestamps_unique": F.size(F.array_distinct("timestamps")) == F.size("timestamps"),
        "timestamps_in_video": ~F.exists("timestamps", lambda t: F.coalesce((t < 0) | (t > F.col("duration_ms")), F.lit(True))),
    }


def picture_rules() -> dict[str, Column]:
    """Rules of a reference picture: path, sha256, mime_type, angle (canonical), captured_at, issued_at, width, height."""
    safe = ~F.col("path").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)") & ~F.col("path").rlike(CONTROLS) & (F.col("path") != "")
    return {
        "path": safe,
        "sha256": F.col("sha256").rlike(SHA256),
        "mime_type": F.col("mime_type").isin(*PICTURE_TYPES),
        "angle": F.col("angle").isNotNull(),
        "captured_in_time": F.col("captured_at") <= F.col("issued_at"),
        "width": F.col("width") >= LEAST_SIDE,
        "height": F.col("height") >= LEAST_SIDE,
    }


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sha256, problem) for each distinct (path, sha256) of ``manifest``: MISSING, DIFFERENT, or null.

    ``files``: path, content. Each file is hashed once, however often the
    manifest names it, and only if it does.
    """
    wanted = manifest.select("path", "sha256").distinct()
    named = files.join(wanted.select("path").distinct(), "path", "left_semi")
    hashed = named.select("path", F.sha2("content", 256).alias("actual"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "MISSING").when(~F.col("actual").eqNullSafe(F.col("sha256")), "DIFFERENT")
    return wanted.join(hashed, "path", "left").select("path", "sha256", problem.alias("problem"))


def manifests_agree(checksums: DataFrame, provenance: DataFrame) -> DataFrame:
    """(path, problem) for paths on which two manifests (path, sha256) disagree, or that only one has."""
    a = checksums.select("path", F.col("sha256").alias("a"))
    b = provenance.select(F.col("path").alias("p"), F.col("sha256").alias("b"))
    joined = a.join(b, a["path"] == b["p"], "full_outer")
    problem = first_reason(
        (F.col("p").isNull(), "NOT_IN_PROVENANCE"), (F.col("path").isNull(), "NOT_IN_CHECKSUMS"), (~F.coalesce(F.col("a") == F.col("b"), F.lit(False)), "DIGESTS_DISAGREE")
    )
    return joined.select(F.coalesce("path", "p").alias("path"), problem.alias("problem")).where("problem is not null")


def metric_rules(rates: tuple[str, ...] = ("top1", "top5", "far", "frr", "open_set_rejection")) -> dict[str, Column]:
    """Invariants of a record of measured rates.

    Columns: the rates, per_view (map angle -> recall), counts (map), status,
    digests (map), thresholds (map) and threshold_fields (array of the names it must have).
    """
    unit = lambda x: x.between(0, 1)
    return {
        **{f"{r}_in_unit": unit(F.col(r)) for r in rates},
        "top5_at_least_top1": F.col("top5") >= F.col("top1"),
        "rejection_is_complement": F.abs(F.col("open_set_rejection") - (1 - F.col("far"))) <= 1e-6,
        "per_view_present": F.size("per_view") > 0,
        "per_view_named": ~F.exists(F.map_keys("per_view"), lambda k: F.trim(k) == ""),
        "per_view_in_unit": ~F.exists(F.map_values("per_view"), lambda v: ~F.coalesce(unit(v), F.lit(False))),
        "counts_positive": ~F.exists(F.map_values("counts"), lambda v: ~F.coalesce(v >= 1, F.lit(False))),
        "calibrated": F.col("status") == "CALIBRATED",
        "digests": ~F.exists(F.map_values("digests"), lambda d: ~F.coalesce(d.rlike(SHA256), F.lit(False))),
        "thresholds_complete": F.array_sort(F.map_keys("thresholds")) == F.array_sort("threshold_fields"),
    }


def entry_violations(entries: DataFrame, chunks: DataFrame, dimension: int, spaces: list[str]) -> DataFrame:
    """(source_id, rule) for entries of a knowledge manifest that break its rules.

    ``entries``: source_id, title, text, content_sha256, space, published_at (ISO
    date or UNKNOWN), vector. ``chunks``: source_id, position, text,
    chunk_sha256. A source_id is an identifier and occurs once; chunks have
    contiguous positions from 0, right digests, and give back the text: their
    lengths add up, and each stands in the text where those before it end.
    """
    v = F.col("vector")
    rules = {
        "source_id": F.col("source_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"),
        "title": F.trim("title") != "",
        "digest": F.col("content_sha256") == F.sha2("text", 256),
        "space": F.col("space").isin(*spaces),
        "published_at": F.col("published_at").rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|UNKNOWN)$"),
        "vector": (F.size(v) == dimension) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    own = entries.select("source_id", F.explode(broken).alias("rule"))
    repeated = entries.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("repeated").alias("rule"))
    placed = running(chunks.withColumn("letters", F.length("text")), ["source_id"], ["position", "chunk_sha256"], number="expected", totals={"start": "letters"})
    placed = placed.withColumns({"expected": F.col("expected") - 1, "start": F.coalesce(F.col("start") - F.coalesce("letters", F.lit(0)), F.lit(0))})
    held = placed.join(entries.select("source_id", F.col("text").alias("whole")), "source_id")
    part = F.substring(F.col("whole"), (F.col("start") + 1).cast("int"), F.length("text"))
    gaps = held.groupBy("source_id").agg(
        F.bool_or(F.col("position") != F.col("expected")).alias("chunk_positions"), F.bool_or(F.col("chunk_sha256") != F.sha2("text", 256)).alias("chunk_digests"),
        (F.bool_or(~part.eqNullSafe(F.col("text"))) | (F.sum(F.length("text")) != F.max(F.length("whole")))).alias("chunk_texts"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(n), n) for n in ("chunk_positions", "chunk_digests", "chunk_texts")]))
    without = entries.join(chunks.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit("no_chunks").alias("rule"))
    return own.unionByName(repeated).unionByName(gaps.select("source_id", F.explode(names).alias("rule"))).unionByName(without)


def binding_violations(rows: DataFrame, bindings: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, position, rule): rows and bindings of a key are zipped by position, and each pair must agree in ``columns``.

    Both have key and position. A position on one side only is named, as is the
    first column, in order, that differs (null equals null).
    """
    a = rows.select(F.col(key).alias("ak"), F.col("position").alias("ap"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = bindings.select(F.col(key).alias("bk"), F.col("position").alias("bp"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = a.join(b, (F.col("ak") == F.col("bk")) & (F.col("ap") == F.col("bp")), "full_outer")
    differing = [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c}_DIFFERS") for c in columns]
    rule = first_reason((F.col("bp").isNull(), "NOT_BOUND"), (F.col("ap").isNull(), "NO_ROW"), *differing)
    return joined.select(F.coalesce("ak", "bk").alias(key), F.coalesce("ap", "bp").alias("position"), rule.alias("rule")).where("rule is not null")


def type_problem(declared: Column, detected: Column) -> Column:
    """How a declared media type stands to the detected one; null if they agree."""
    return F.when(detected.isNull(), "UNSUPPORTED").when(~declared.eqNullSafe(detected), "DECLARED_DIFFERS")


def conservative(result: Column, valid: Column, fallback: dict) -> Column:
    """``result`` where it is valid, else the fallback, a struct of the same fields that assumes the worst."""
    worst = F.struct(*[F.lit(v).alias(k) for k, v in fallback.items()])
    return F.when(F.coalesce(valid, F.lit(False)), result).otherwise(worst)


def recovery(state: Column, server_id: Column, message: Column, complete: Column) -> Column:
    """What a client does to go on with a job: upload, poll, ask for the model again, or (null) nothing.

    Only jobs with their whole set of captures go on. A failed job whose message
    speaks of identity or configuration starts over where it stood.
    """
    # What such a message holds.
    setup = message.rlike("认证|配置|注册|令牌|HTTP 401|HTTP 403") & (state == "FAILED")
    known = server_id.isNotNull()
    action = (
        F.when((state == "MODEL_UNAVAILABLE") & known, "SERVER_MODEL_RETRY")
        .when(state.isin("READY", "UPLOADING") & ~known, "UPLOAD")
        .when((state == "POLLING") & known, "POLL")
        .when(F.coalesce(setup, F.lit(False)) & ~known, "UPLOAD")
        .when(F.coalesce(setup, F.lit(False)) & known, "POLL")
    )
    return F.when(complete, action)


def readiness(*stages: tuple[Column, str], ready: str = "READY") -> Column:
    """The code of the first stage, in order, that isn't there; ``ready`` if all are. A null counts as missing."""
    return F.coalesce(first_reason(*[(~F.coalesce(ok, F.lit(False)), code) for ok, code in stages]), F.lit(ready))


def latest_distinct(rows: DataFrame, key: str, item: str, order: list[str], most: int) -> DataFrame:
    """(key, position, item): the newest ``most`` items of each key, each where it first came, newest first; null items don't count."""
    first = rows.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.min(F.struct(*order)).alias("at"))
    placed = running(first, [key], [F.desc("at"), F.desc(item)], number="position")
    return placed.select(key, F.col("position").cast("int").alias("position"), item).where(F.col("position") <= most)


def rounds(rows: DataFrame, key: str, order: list[str], out_col: str = "round") -> DataFrame:
    """``rows`` numbered within their key: how many came before, and one."""
    return running(rows, [key], order, number=out_col)


def with_defaults(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """An older table in a newer form: each column it lacks is added with its default; its own stay as they are."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({name: default for name, default in columns.items() if name.lower() not in have})


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], out_col: str) -> DataFrame:
    """``parents`` with their children as a sorted array of structs; no children: an empty one.

    Meant for parents with few children, as a job has captures: a parent's are
    gathered in its row.
    """
    k = fresh_name(parents, "child_key")
    listed = children.groupBy(F.col(child_key).alias(k)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out_col))
    joined = parents.join(listed, parents[key] == listed[k], "left").drop(k)
    return joined.withColumn(out_col, F.coalesce(out_col, F.array().cast(listed.schema[out_col].dataType)))


_ACTION_LOG = "session bigint, seq bigint, verdict string, used double, reserved double, locked boolean"


def replay_actions(log: DataFrame, limit: float) -> DataFrame:
    """(session, seq, verdict, used, reserved, locked) after every entry of an action log.

    ``log``: session, seq, kind, run, load, valid. A session has one budget of
    ``limit`` and at most one open action. ``reserve`` opens a run if the budget
    isn't locked and has room (used + reserved + load, to a billionth); ``claim``
    starts it, once; ``settle`` ends it, once: with valid telemetry the load that
    is stated, if any, is charged, else the reserved one. Without valid telemetry,
    or when the charges pass the limit, the budget is locked. A refused entry changes nothing. A
    session is a fold in order: tasks stream over sorted logs and hold one
    session's state, and the names of its settled runs.
    """
    rows = log.select("session", "seq", "kind", "run", F.col("load").cast("double"), F.coalesce("valid", F.lit(False)).alias("valid"))
    dealt = rows.repartition("session").sortWithinPartitions("session", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            out = []
            for session, _, kind, run, load, valid in zip(*[c.to_pylist() for c in batch.columns]):
                if session != at:
                    at, state = session, ActionState(limit)
                out.append((state.apply(kind, run, load, valid), state.used, state.reserved, state.locked))
            columns = list(zip(*out)) if out else [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["session", "seq", "verdict", "used", "reserved", "locked"])

    return dealt.mapInArrow(fold, _ACTION_LOG)


class ActionState:
    """A session's budget and its open action; ``apply`` is one transition."""

    def __init__(self, limit: float, used: float = 0.0, reserved: float = 0.0, locked: bool = False, run: str | None = None, claimed: bool = False, settled: set[str] | None = None):
        self.limit, self.used, self.reserved, self.locked = limit, used, reserved, locked
        self.run, self.claimed, self.settled = run, claimed, settled if settled is not None else set()

    def apply(self, kind: str | None, run: str | None, load: float | None, valid: bool) -> str:
        if kind == "reserve":
            return self._reserve(run, load)
        if kind not in ("claim", "settle"):
            return "UNKNOWN_KIND"
        if run in self.settled:
            return "ALREADY_SETTLED"
        if run is None or run != self.run:
            return "NOT_RESERVED"
        if kind == "claim":
            verdict = "IN_PROGRESS" if self.claimed else "CLAIMED"
            self.claimed = True
            return verdict
        charge = max(0.0, load) if valid and load is not None else self.reserved
        self.used, self.reserved = round(self.used + charge, 6), 0.0
        self.locked = self.locked or not valid or self.used > self.limit + 1e-9
        self.settled.add(run)
        self.run, self.claimed = None, False
        return "SETTLED" if valid else "SETTLED_AT_PREDICTION"

    def _reserve(self, run: str | None, load: float | None) -> str:
        if self.run is not None:
            return "ALREADY_RESERVED"
        if run is None or load is None or run in self.settled:
            return "INVALID"
        if self.locked:
            return "LOCKED"
        if self.used + self.reserved + load > self.limit + 1e-9:
            return "OVER_BUDGET"
        self.run, self.reserved = run, round(load, 6)
        return "RESERVED"
