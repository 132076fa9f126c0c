"""Admission and the store: drafts, a queue per root, and commits that readers see whole or not at all.

The store is a folder that Spark's file systems can reach. Everything that a commit writes lies in a folder of its own,
named by the commit's number and an attempt; then one numbered head file is put beside the earlier ones by a rename that
never overwrites. That rename is the commit point: what an attempt wrote before it is invisible without it, a retry
writes another folder, and of two writers only one gets the number. Heads are never changed or removed, so they are the
history of admissions and of applied identities, too.

An inventory is a base, sorted by (path, resource_id) over files whose bounds the head knows, and the changed rows of later
commits; it is written anew when these come to a quarter of it. A page reads the files that it falls in and no others.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import apply, controls, evidence, reader, reconcile

# What an admission ends as, and what a snapshot is until then.
APPLIED, NOOP, REJECTED, STALE_INPUT = "APPLIED", "NOOP", "REJECTED", "STALE_INPUT"
DRAFT, SUBMITTED, EVALUATED = "DRAFT", "SUBMITTED", "EVALUATED"

#: Rows of one file of a base; share of a base's rows at which the changed ones are merged into a new one.
FILE_ROWS, MERGE_SHARE = 500_000, 0.25


def safe(name: str) -> str:
    """name as one part of a path, without signs that a file system or a path's reader gives a meaning."""
    return quote(name, "").replace("~", "%7E").replace("%", "~")


class Conflict(RuntimeError):
    """Another writer, or an earlier call, has taken this step."""


@dataclass
class Head:
    """The state of a root after its number-th terminal admission, and that admission."""

    root_id: str
    number: int = 0
    seq: int = 0
    snapshot_id: str | None = None
    outcome: str | None = None
    identity: str | None = None
    folder: str | None = None  # of this commit, if it wrote any
    events: int = 0
    generation: int = 0
    last_event: int = 0
    applied_seq: int = 0
    base: str | None = None
    base_rows: int = 0
    files: list = field(default_factory=list)  # (first path, first id, name), in order
    changes: list = field(default_factory=list)  # folders of changed rows since the base
    change_rows: int = 0


HEAD = "root_id string, number long, seq long, snapshot_id string, outcome string, identity string, folder string, events long, generation long, last_event long, applied_seq long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{folder}")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(".")) if fs.exists(p) else []

    def _read(self, name: str) -> dict:
        p, fs = self._fs(f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, folder: str, name: str, value: dict) -> bool:
        """Write a small file whole; False if one of that name is there already."""
        jvm = self.spark._jvm
        new, fs = self._fs(f"{self.path}/{folder}/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray((json.dumps(value) + "\n").encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/{folder}/{name}")
        if fs.exists(to):
            fs.delete(new, False)
            return False
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(to), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(new, False)
            return False
        return True

    # ---- heads and what they name

    def load(self, root_id: str) -> Head:
        names = self._names(f"heads/{safe(root_id)}")
        return Head(**self._read(f"heads/{safe(root_id)}/{names[-1]}")) if names else Head(root_id)

    def commit(self, head: Head) -> None:
        """The commit point. Raises Conflict if another writer has the number."""
        if not self._put(f"heads/{safe(head.root_id)}", f"{head.number:012d}.json", asdict(head)):
            raise Conflict(f"{head.root_id} has moved on")

    def admissions(self, root_id: str) -> DataFrame:
        """One row per terminal admission, in the order of `number`: its outcome, identity and the generation after it."""
        if not self._names(f"heads/{safe(root_id)}"):
            return self.spark.createDataFrame([], HEAD)
        return self.spark.read.schema(HEAD).json(f"{self.path}/heads/{safe(root_id)}")

    def _committed(self, root_id: str, table: str, schema: str) -> DataFrame:
        folders = [r["folder"] for r in self.admissions(root_id).filter("folder is not null and outcome = 'APPLIED'").orderBy("number").select("folder").collect()]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/{table}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def journal(self, root_id: str) -> DataFrame:
        return self._committed(root_id, "journal", JOURNAL)

    def observations(self, root_id: str) -> DataFrame:
        """What each applied snapshot saw of each resource (the evidence that `latest.with_latest_evidence` joins)."""
        return self._committed(root_id, "observations", OBSERVATION)

    def _rows(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(PRIOR).parquet(*[f"{self.path}/{p}" for p in paths])

    def _changed(self, head: Head) -> DataFrame | None:
        """The last state of each row that has changed since the base."""
        if not head.changes:
            return None
        rows = self.spark.read.schema(PRIOR + ", __number long").parquet(*[f"{self.path}/{f}" for f in head.changes])
        if len(head.changes) == 1:
            return rows.drop("__number")
        last = rows.groupBy("root_id", "resource_id").agg(F.max_by(F.struct(*COLUMNS), "__number").alias("r"))
        return last.select("r.*")

    def inventory(self, head: Head) -> DataFrame | None:
        """The root's rows as of a head, or None before its first."""
        if not head.base:
            return None
        changed = self._changed(head)
        base = self._rows(head.base)
        return base if changed is None else base.join(changed.select("root_id", "resource_id"), ["root_id", "resource_id"], "left_anti").unionByName(changed)

    # ---- pages

    def _file(self, head: Head, k: int, changed: DataFrame | None) -> DataFrame:
        """The rows between the bounds of the k-th file, not in order if some have changed."""
        rows = self._rows(f"{head.base}/{head.files[k][2]}")
        if changed is None:
            return rows
        at = F.struct(F.coalesce("path", F.lit("")).alias("p"), F.col("resource_id").alias("r"))
        bound = lambda j: F.struct(F.lit(head.files[j][0]).alias("p"), F.lit(head.files[j][1]).alias("r"))
        own = changed if k == 0 else changed.filter(at >= bound(k))
        own = own if k == len(head.files) - 1 else own.filter(at < bound(k + 1))
        return rows.join(changed.select("resource_id"), "resource_id", "left_anti").unionByName(own)

    def page(self, head: Head, limit: int | None = None, cursor: str | None = None, where: Column | None = None) -> list:
        """The next `limit` rows by (path, resource_id) after the cursor: only the files that they lie in are read."""
        limit, out = reader.page_limit(limit), []
        after = None
        if cursor is not None:
            root, generation, *after = reader.decode_cursor(cursor)
            if (root, generation) != (head.root_id, head.generation):
                raise reader.StaleCursor("the listing has changed")
        first = max(0, bisect.bisect_right([tuple(f[:2]) for f in head.files], tuple(after)) - 1) if after else 0
        changed = self._changed(head)
        for k in range(first, len(head.files)):
            rows = self._file(head, k, changed)
            rows = rows if where is None else rows.filter(where)
            path = F.coalesce("path", F.lit(""))
            if after:
                rows = rows.filter((path > after[0]) | ((path == after[0]) & (F.col("resource_id") > after[1])))
            out += rows.orderBy(path, "resource_id").limit(limit - len(out)).collect()
            if len(out) >= limit:
                break
        return out

    def pages(self, head: Head, limit: int | None = None, where: Column | None = None) -> Iterator[tuple[pa.Table, str | None]]:
        """All pages of one head in order, as (Arrow table, next cursor), a file at a time; no shuffle."""
        limit = reader.page_limit(limit)
        changed = self._changed(head)
        held = None
        for k in range(len(head.files)):
            rows = self._file(head, k, changed)
            rows = rows if where is None else rows.filter(where)
            t = (rows if changed is None else rows.coalesce(1).sortWithinPartitions(F.coalesce("path", F.lit("")), "resource_id")).toArrow()
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= limit:
                last = held.slice(limit - 1, 1).to_pylist()[0]
                yield held.slice(0, limit), reader.encode_cursor(head.root_id, head.generation, last["path"] or "", last["resource_id"])
                held = held.slice(limit)
        yield (self._rows(head.base).limit(0).toArrow() if head.base else pa.table({})) if held is None else held, None

    # ---- snapshots and the queue

    def _snapshot(self, root_id: str, snapshot_id: str) -> str:
        return f"snapshots/{safe(root_id)}/{safe(snapshot_id)}"

    def draft(self, root_id: str, snapshot: dict, entries: DataFrame) -> None:
        """Keep a snapshot's evidence and entries. The evidence comes last, so a draft is there whole or not at all."""
        at = self._snapshot(root_id, snapshot["snapshot_id"])
        if self._names(at):
            raise Conflict(f"there is a snapshot {snapshot['snapshot_id']}")
        table = f"entries-{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/{at}-rows/{table}")
        if not self._put(at, "DRAFT.json", snapshot | {"root_id": root_id, "entries": table}):
            raise Conflict(f"there is a snapshot {snapshot['snapshot_id']}")

    def submit(self, root_id: str, snapshot_id: str) -> None:
        """DRAFT to SUBMITTED, once."""
        at = self._snapshot(root_id, snapshot_id)
        if "DRAFT.json" not in self._names(at):
            raise Conflict(f"no draft {snapshot_id}")
        if not self._put(at, "SUBMITTED.json", {}):
            raise Conflict(f"{snapshot_id} is submitted already")

    def state(self, root_id: str, snapshot_id: str) -> str | None:
        names = self._names(self._snapshot(root_id, snapshot_id))
        if not names:
            return None
        if "SUBMITTED.json" not in names:
            return DRAFT
        return EVALUATED if self.admissions(root_id).filter((F.col("snapshot_id") == snapshot_id) & (F.col("outcome") != STALE_INPUT)).head(1) else SUBMITTED

    def get_snapshot(self, root_id: str, snapshot_id: str) -> tuple[dict, DataFrame]:
        """(evidence, entries) of a snapshot."""
        at = self._snapshot(root_id, snapshot_id)
        facts = self._read(f"{at}/DRAFT.json")
        return facts, self.spark.read.parquet(f"{self.path}/{at}-rows/{facts.pop('entries')}")

    def queue(self, root_id: str) -> list[tuple[int, str]]:
        """(number, snapshot) of all admissions of a root, in order."""
        at = f"queue/{safe(root_id)}"
        return [(int(n[:12]), self._read(f"{at}/{n}")["snapshot_id"]) for n in self._names(at)]

    def admit(self, root_id: str, snapshot_id: str) -> int:
        """The submitted snapshot's number in the queue: the one that it has, or the next."""
        if "SUBMITTED.json" not in self._names(self._snapshot(root_id, snapshot_id)):
            raise Conflict(f"{snapshot_id} isn't submitted")
        while True:
            held = self.queue(root_id)
            known = [n for n, s in held if s == snapshot_id]
            if known:
                return known[0]
            n = held[-1][0] + 1 if held else 1
            if self._put(f"queue/{safe(root_id)}", f"{n:012d}.json", {"snapshot_id": snapshot_id}):
                return n

    def recover(self, root_id: str) -> tuple[int | None, list[str]]:
        """Admit the one submitted snapshot that nothing has admitted; several are ambiguous and stay: (number, those)."""
        done = {s for _, s in self.queue(root_id)}
        at = f"snapshots/{safe(root_id)}"
        ids = [self._read(f"{at}/{n}/DRAFT.json")["snapshot_id"] for n in self._names(at) if not n.endswith("-rows") and "SUBMITTED.json" in self._names(f"{at}/{n}")]
        lost = [s for s in ids if s not in done]
        return (self.admit(root_id, lost[0]) if len(lost) == 1 else None), lost


PRIOR = "root_id string, resource_id string, path string, is_dir boolean, size long, mtime long, hash string, alg string, content_type string, provider_id string, provider_scope string, assurance string, presence string, evidence string, missing_since long, consecutive long, missing_first string, missing_last string, confirmed_generation long"
COLUMNS = [x.split()[0] for x in PRIOR.split(", ")]
JOURNAL = "root_id string, generation long, intra_seq long, event_seq long, event_type string, resource_id string, payload string"
OBSERVATION = "root_id string, resource_id string, observation_id string, snapshot_id string, entry_id string, observed_path string, provider_id string, provider_scope string, assurance string, hash string, alg string, observed_at long"
FACTS = ("traversal", "error_summary", "skipped_scopes", "skipped_known_empty", "freshness", "assurance", "used_cache", "corroboration")


def together(*jobs):
    """What some independent jobs return, run at once: none of them alone keeps a cluster busy."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [j.result() for j in [pool.submit(f) for f in jobs]]


def evaluate(prior: DataFrame, entries: DataFrame, snapshot: dict, resolved: DataFrame) -> tuple[str, str]:
    """(acceptance, identity) of a snapshot against a root's inventory. The identity says what was seen and what it decides
    about removal: a snapshot of the same identity at the same generation changes nothing."""
    spark = prior.sparkSession
    n_entries, n_present, context = together(entries.count, prior.filter("presence = 'PRESENT'").count, reconcile.removal_context(prior, resolved).first)
    facts = {k: snapshot.get(k) for k in FACTS} | {"entries": n_entries, "prior_present": n_present}
    kind = "traversal string, error_summary string, skipped_scopes string, skipped_known_empty boolean, freshness string, assurance string, used_cache boolean, corroboration string, entries long, prior_present long"
    accepted = evidence.acceptance(spark.createDataFrame([tuple(facts.values())], kind)).first()["acceptance"]
    if accepted == "FAILED":
        return accepted, ""
    digest = controls.entry_digest(entries, evidence=(*(None if facts[k] is None else str(facts[k]) for k in FACTS), accepted, context["context"] if context else "")).first()
    return accepted, digest["digest"] if digest else f"none-{accepted}-{context['context'] if context else ''}"


def observed(entries: DataFrame, transitions: DataFrame, number: int, snapshot: dict) -> DataFrame:
    """OBSERVATION rows: what the snapshot saw of each resource it resolved to, at the snapshot's time."""
    c = F.col
    seen = transitions.filter("resource_id is not null and entry_id is not null").select("root_id", "resource_id", "entry_id").distinct()
    return seen.join(entries, ["root_id", "entry_id"]).select(
        "root_id", "resource_id", F.concat(F.lit(f"{number:012d}-"), c("entry_id")).alias("observation_id"), F.lit(snapshot["snapshot_id"]).alias("snapshot_id"), "entry_id", evidence.entry_path(c("parent_ref"), c("name")).alias("observed_path"),
        "provider_id", "provider_scope", F.coalesce("assurance", F.lit("UNVERIFIED")).alias("assurance"), "hash", "alg", F.lit(snapshot["observed_at"]).cast("long").alias("observed_at"),
    )


def process(store: Store, root_id: str, seq: int, snapshot: dict, entries: DataFrame, cfg: reconcile.Config) -> str:
    """Admit one snapshot of a root: evaluate, reconcile, commit. Returns the outcome, which a head keeps.

    snapshot: snapshot_id, observed_at (microseconds) and the evidence columns of evidence.acceptance. FAILED is
    REJECTED; a number not above the last terminal one is STALE_INPUT, unless it is that very admission, whose outcome a
    retry gets again; an identity applied at exactly the current generation is a NOOP. Evidence-only changes are APPLIED
    without a new generation and without events.
    """
    spark, head, sid = store.spark, store.load(root_id), snapshot["snapshot_id"]
    own = Head(**asdict(head) | {"number": head.number + 1, "seq": seq, "snapshot_id": sid, "folder": None, "events": 0, "identity": None})

    def end(outcome: str) -> str:
        own.outcome, own.applied_seq = outcome, max(seq, head.applied_seq)
        store.commit(own)
        return outcome

    if seq <= head.applied_seq:
        before = store.admissions(root_id).filter((F.col("seq") == seq) & (F.col("snapshot_id") == sid)).orderBy("number").head(1)
        return before[0]["outcome"] if before else end(STALE_INPUT)
    if snapshot.get("traversal") == "FAILED":
        return end(REJECTED)
    prior = store.inventory(head)
    prior = spark.createDataFrame([], PRIOR) if prior is None else prior
    now, name = F.lit(snapshot["observed_at"]), F.lit(sid)
    folder = f"commits/{safe(root_id)}/{own.number:012d}-{uuid.uuid4().hex}"
    write = lambda df, table: df.write.parquet(f"{store.path}/{folder}/{table}")
    write(reconcile.resolve(prior, entries, now, cfg.move_horizon), "resolved")  # read three times
    resolved = spark.read.parquet(f"{store.path}/{folder}/resolved")
    accepted, own.identity = evaluate(prior, entries, snapshot, resolved)
    if accepted == "FAILED":
        return end(REJECTED)
    if head.base and store.admissions(root_id).filter((F.col("identity") == own.identity) & (F.col("outcome") == APPLIED) & (F.col("generation") == head.generation)).head(1):
        return end(NOOP)
    write(reconcile.reconcile(prior, entries, accepted, cfg, now, name, resolved), "transitions")
    t = spark.read.parquet(f"{store.path}/{folder}/transitions")
    sizes = t.agg(F.count_if(F.col("kind").isin(*reconcile.GENERATION_KINDS)).alias("n"), F.count_if(F.col("entry_id").isNotNull()).alias("e")).first()
    own.generation = head.generation + (sizes["n"] > 0)
    own.folder, own.events = folder, sizes["n"]  # each kind that raises the generation has an event
    g = spark.createDataFrame([(root_id, own.generation)], "root_id string, generation long")
    after = _with_identities(apply.apply_transitions(prior, entries, t, g), prior, entries, t)
    own.last_event = head.last_event + own.events

    def journal() -> None:
        last = spark.createDataFrame([(root_id, head.last_event)], "root_id string, event_seq long")
        write(apply.events(t, g, last) if own.events else spark.createDataFrame([], JOURNAL), "journal")

    def rows() -> None:
        if not head.base:
            return _write_base(store, own, folder, after, sizes["e"])
        was = prior.select("root_id", "resource_id", F.struct(*COLUMNS).alias("__was"))
        changed = after.join(was, ["root_id", "resource_id"], "left").filter(~F.struct(*COLUMNS).eqNullSafe(F.col("__was"))).select(*COLUMNS, F.lit(own.number).cast("long").alias("__number"))
        write(changed, "changed")
        n = spark.read.parquet(f"{store.path}/{folder}/changed").count()
        own.changes, own.change_rows = [*head.changes, f"{folder}/changed"], head.change_rows + n
        if own.change_rows > MERGE_SHARE * head.base_rows:
            _write_base(store, own, folder, store.inventory(own), head.base_rows + own.change_rows)

    together(lambda: write(observed(entries, t, own.number, snapshot), "observations"), journal, rows)
    return end(APPLIED)


def _with_identities(after: DataFrame, prior: DataFrame, entries: DataFrame, t: DataFrame) -> DataFrame:
    """after with the provider identity of the entry last seen, else of before."""
    ids = prior.select("root_id", "resource_id", "provider_id", "provider_scope", "assurance")
    seen = t.filter("resource_id is not null and entry_id is not null").select("root_id", "resource_id", "entry_id").distinct().join(entries.select("root_id", "entry_id", F.col("provider_id").alias("n_id"), F.col("provider_scope").alias("n_scope"), F.col("assurance").alias("n_assurance")), ["root_id", "entry_id"])
    seen = seen.groupBy("root_id", "resource_id").agg(F.max_by(F.struct("n_id", "n_scope", "n_assurance"), "entry_id").alias("n"))
    after = after.join(ids, ["root_id", "resource_id"], "left").join(seen, ["root_id", "resource_id"], "left")
    newer = {"provider_id": "n_id", "provider_scope": "n_scope", "assurance": "n_assurance"}
    return after.select(*[F.when(F.col("n").isNotNull(), F.col(f"n.{newer[c]}")).otherwise(F.col(c)).alias(c) if c in newer else F.col(c) for c in COLUMNS])


def _write_base(store: Store, head: Head, folder: str, rows: DataFrame, about: int) -> None:
    """Write rows as files in order of (path, resource_id), and note their bounds in the head."""
    path = F.coalesce("path", F.lit(""))
    at = f"{folder}/base"
    rows.repartitionByRange(max(1, -(-about // FILE_ROWS)), path, F.col("resource_id")).sortWithinPartitions(path, "resource_id").write.option("maxRecordsPerFile", 0).parquet(f"{store.path}/{at}")
    files = store._rows(at).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(F.struct(path.alias("p"), "resource_id")).alias("m"), F.count("*").alias("n")).collect()
    head.base, head.base_rows, head.changes, head.change_rows = at, sum(r["n"] for r in files), [], 0
    head.files = sorted([r["m"]["p"], r["m"]["resource_id"], r["f"]] for r in files)


def process_snapshot(store: Store, root_id: str, snapshot_id: str, cfg: reconcile.Config) -> str | None:
    """Admit a submitted snapshot, or take up its admission again, and process the queue up to it: its outcome."""
    seq = store.admit(root_id, snapshot_id)
    while True:
        done = store.admissions(root_id).filter((F.col("seq") == seq) & (F.col("snapshot_id") == snapshot_id)).orderBy("number").head(1)
        if done or not process_head(store, root_id, cfg):
            return done[0]["outcome"] if done else None


def process_head(store: Store, root_id: str, cfg: reconcile.Config) -> tuple[int, str] | None:
    """Process the first admission in the queue that isn't terminal: (number, outcome), or None if there is none."""
    last = store.load(root_id).applied_seq
    for seq, sid in store.queue(root_id):
        if seq > last:
            facts, entries = store.get_snapshot(root_id, sid)
            return seq, process(store, root_id, seq, facts, entries, cfg)
    return None


def drain(store: Store, root_ids: list[str], cfg: reconcile.Config, parallel: int = 4) -> dict[str, list[tuple[int, str]]]:
    """The admission worker: each root's queue in order, `parallel` roots at once. A root that fails doesn't stop others; its
    error is raised at the end, when the others are done."""

    def one(root_id: str) -> list[tuple[int, str]]:
        out = []
        while (done := process_head(store, root_id, cfg)) is not None:
            out.append(done)
        return out

    with ThreadPoolExecutor(parallel) as pool:
        jobs = {r: pool.submit(one, r) for r in root_ids}
    return {r: j.result() for r, j in jobs.items()}
