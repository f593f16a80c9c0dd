"""Hand-curated tables: vocabularies, caches, allow-lists, overrides, manifests."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns strings; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def vocabulary(rows: DataFrame, modes: dict[str, str], otherwise: str = "compound") -> DataFrame:
    """(word, mode, variants, translation, reference) of a word list with word, type, variants (``[A|B]``), translation and ref: capitals, variants longest first, the word itself if it has none."""
    kinds = F.create_map(*(F.lit(x) for kv in modes.items() for x in kv))
    word = F.upper(F.trim(F.coalesce("word", F.lit(""))))
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.trim(F.coalesce("variants", F.lit(""))), r"^\[+|\]+$", ""), r"\|"), lambda v: F.upper(F.trim(v))), lambda v: v != "")
    numbered = F.transform(listed, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    longest = F.transform(F.array_sort(numbered), lambda x: x["v"])

    def bare(c: str) -> Column:
        return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), '^"+|"+$', "")

    return rows.where(word != "").select(word.alias("word"), F.coalesce(F.try_element_at(kinds, F.trim("type")), F.lit(otherwise)).alias("mode"), F.when(F.size(longest) > 0, longest).otherwise(F.array(word)).alias("variants"), bare("translation").alias("translation"), bare("ref").alias("reference"))


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file as ``read_csv`` gives it, with ``line``, which rises with the rows' order in the file."""
    return read_csv(spark, path).withColumn("line", F.monotonically_increasing_id())


def cache(rows: DataFrame, *, key: list[str], order: str = "") -> DataFrame:
    """A cache's rows, of repeated keys the last one by ``order`` (without one the greatest by all other columns); rows without a key are dropped."""
    rest = [c for c in rows.columns if c not in key]
    held = rows.where(" and ".join(f"length({k}) > 0" for k in key))
    best = F.max_by(F.struct(*rest), order) if order else F.max(F.struct(*rest))
    return held.groupBy(*key).agg(best.alias("r")).select(*key, *(f"r.{c}" for c in rest if c != order))


def links_cache(rows: DataFrame, *, key: list[str], order: str = "") -> DataFrame:
    """A cache whose confidence is a number, 0 where it is blank or none."""
    return cache(rows, key=key, order=order).withColumn("confidence", F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.0)))


def settled(rows: DataFrame, *, key: str, status: str = "not-recoverable") -> DataFrame:
    """(key, note) of the entries that somebody has settled: nothing more is to be found."""
    return rows.where((F.length(key) > 0) & (F.col("status") == status)).select(key, "note")


def ontology_classes(graph: DataFrame, predicate: str = "http://www.w3.org/2000/01/rdf-schema#subClassOf") -> DataFrame:
    """(term): what is a subclass of something."""
    return graph.where(F.col("p") == predicate).select(F.col("s").alias("term")).distinct()


def choose_source(choices: list[tuple[str, str | None]], usable: Callable[[str], bool]) -> tuple[str, str]:
    """(path, reason) of the first of some (reason, path) that is given and usable; ValueError if none is."""
    for reason, path in choices:
        if path and usable(path):
            return path, reason
    raise ValueError("no source of editions can be used: " + ", ".join(reason for reason, _ in choices))


def git_head(folder: str) -> dict[str, str]:
    """The branch and commit that a checkout's own files tell, without running anything; empty outside a checkout."""
    git = Path(folder) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return {"branch": "", "commit": head}
        ref = head.removeprefix("ref: ")
        if (git / ref).exists():
            return {"branch": ref.rpartition("/")[2], "commit": (git / ref).read_text().strip()}
        packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
        return {"branch": ref.rpartition("/")[2], "commit": next((x.split()[0] for x in packed if x.endswith(" " + ref)), "")}
    except OSError:
        return {}


def allow_list(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, label, qid, wd_label) of a hand-made list of term, qid and wd_label."""
    return rows.where(F.length("qid") > 0).select(F.lit(kind).alias("kind"), F.col("term").alias("label"), "qid", "wd_label")


def overrides(rows: DataFrame, *, key: str, needs: list[str]) -> DataFrame:
    """Rows with a key and all the columns they need."""
    return rows.where(" and ".join(f"length({c}) > 0" for c in [key, *needs]))


def parse_maps(text: str) -> dict:
    """A document of nested ``key: value`` lines (indented, values plain or quoted), as manifests and hand-set identifiers are written; ``- item`` lines below a key make a list; comments and blank lines are skipped."""
    root: dict = {}
    stack = [(-1, root)]
    opened: list[tuple[dict, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        item = re.match(r"^\s*-\s+(.*?)\s*$", line)
        if item and opened:
            holder, name = opened[-1]
            if not holder[name]:
                holder[name] = []
            if isinstance(holder[name], list):
                holder[name].append(item[1].strip("\"'"))
            continue
        m = re.match(r"""^(\s*)("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:#]+?(?::\S[^:#]*)*)\s*:(?:\s+(.*))?$""", line)
        if not m:
            continue
        depth, key, value = len(m[1]), m[2].strip().strip("\"'"), (m[3] or "").strip()
        while stack[-1][0] >= depth:
            stack.pop()
        if value and not value.startswith("#"):
            quoted = re.match(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", value)
            stack[-1][1][key] = quoted[1][1:-1] if quoted else re.sub(r"\s+#.*$", "", value)
        else:
            child: dict = {}
            stack[-1][1][key] = child
            opened.append((stack[-1][1], key))
            stack.append((depth, child))
    return root


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """(commit, path, sha) of one manifest document."""
    doc = parse_maps(text)
    files = doc.get("files") or {}
    return spark.createDataFrame([(doc.get("commit"), p, s) for p, s in files.items()] if isinstance(files, dict) else [], "commit string, path string, sha string")
