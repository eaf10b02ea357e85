"""Result tables, recalculation after corrections, model files, reports."""

from __future__ import annotations

import hashlib
import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lambertlake.functions.kernels import SpectrumError
from lambertlake.operators import methods as m
from lambertlake.operators import stats
from lambertlake.plans import pipeline as pl
from lambertlake.sources import sheets
from lambertlake.storage.project import Project, ProjectError, references, remap

FORMAT = "lambertlake model"


def determine(project: Project, method_id: int, ids: list[int], name: str) -> int:
    """Apply a saved method to spectra and save what it finds."""
    definition = json.loads(project.row("methods", method_id)["definition"])
    method = m.load({k: v for k, v in definition.items() if k not in ("calibration_ids", "revision_of", "revision", "embedded")})
    steps, measurement = getattr(method, "steps", []), getattr(method, "measurement", None)
    library = pl.Library.of(project.table("points"), steps, measurement)
    rows = {r["id"]: r.asDict() for r in m.determine(method, project.spectra(ids), library).collect()}
    compounds = sorted(c.removeprefix("found_") for c in next(iter(rows.values())) if c != "id")
    found = [[rows[i][f"found_{c}"] for c in compounds] for i in ids]
    data = {"ids": ids, "compounds": compounds, "found": found, "excluded_ids": []}
    line = getattr(method, "line", None)
    if line is not None and "t" in line.stats:  # half widths at the signals found
        s = line.stats
        back = lambda c: line.intercept + line.slope * c
        half = lambda c: s["t"] * s["s_yx"] / abs(line.slope) * math.sqrt(1 + 1 / s["n"] + (back(c) - s["y_mean"]) ** 2 / (line.slope**2 * s["sxx"]))
        data["ci95"] = [[half(f[0])] for f in found]
    return project.save_result(name, "determination", data, method_id)


def result_rows(project: Project, result_id: int | None = None) -> DataFrame:
    """id, compound, found, ci, taken, recovery and whether it counts, from the saved documents; missing spectra are passed over."""
    rows = project.results() if result_id is None else project.current("results").where(F.col("id") == result_id)
    shape = "struct<ids:array<long>,compounds:array<string>,found:array<array<double>>,ci95:array<array<double>>,taken_snapshot:map<string,map<string,double>>,excluded_ids:array<long>>"
    doc = rows.select(F.col("id").alias("result_id"), F.from_json("data", shape).alias("d"))
    each = doc.select("result_id", "d", F.posexplode("d.ids").alias("i", "spectrum_id"))
    each = each.select("result_id", "d", "i", "spectrum_id", F.posexplode("d.compounds").alias("j", "compound"))
    # A compound that the snapshot doesn't list wasn't taken.
    snapshot = F.try_element_at(F.col("d.taken_snapshot"), F.col("spectrum_id").cast("string"))
    each = each.select(
        "result_id", "i", "spectrum_id", "compound", F.get(F.get(F.col("d.found"), F.col("i")), F.col("j")).alias("found"), F.get(F.get(F.col("d.ci95"), F.col("i")), F.col("j")).alias("ci"),
        F.try_element_at(snapshot, F.col("compound")).alias("saved"), snapshot.isNull().alias("unsaved"), F.coalesce(F.array_contains("d.excluded_ids", F.col("spectrum_id")), F.lit(False)).alias("excluded"),
    )
    live = project.current("spectra").select(F.col("id").alias("spectrum_id"), "name", "concentrations")
    out = each.join(live, "spectrum_id").withColumn("now", F.try_element_at("concentrations", F.col("compound")))
    out = out.withColumn("taken", F.when(F.col("unsaved"), F.col("now")).otherwise(F.col("saved")))
    out = out.withColumn("recovery", 100 * F.try_divide("found", F.when(F.col("taken") > 0, F.col("taken"))))
    return out.select("result_id", "spectrum_id", "name", "compound", "found", "ci", "taken", "recovery", "excluded", (~F.col("unsaved") & ~F.col("saved").eqNullSafe(F.col("now"))).alias("stale"))


def result_summary(project: Project, result_id: int | None = None) -> DataFrame:
    """Recovery statistics of each result and compound, excluded rows left out."""
    return stats.describe(result_rows(project, result_id).where(~F.col("excluded") & F.col("recovery").isNotNull()), "recovery", ["result_id", "compound"])


def outliers(project: Project, result_id: int, alpha: float = 0.05, test: str = "grubbs") -> DataFrame:
    """Recoveries that stand out by Grubbs' or Dixon's test, to be looked at; nothing is excluded by this."""
    if test not in ("grubbs", "dixon"):
        raise ValueError("the test is grubbs or dixon")
    rows = result_rows(project, result_id).where(~F.col("excluded") & F.col("recovery").isNotNull())
    if test == "dixon":
        return stats.dixon(rows, "recovery", ["compound"], alpha, "spectrum_id").where("outlier")
    return stats.grubbs(rows, "recovery", "spectrum_id", ["compound"], alpha).where("outlier")


def exclude(project: Project, result_id: int, ids: list[int], reason: str) -> int:
    data = json.loads(project.row("results", result_id)["data"])
    return project.revise("results", result_id, data | {"excluded_ids": sorted({*data.get("excluded_ids", []), *ids})}, reason)


def stale(project: Project) -> list[int]:
    """Results whose saved amounts differ from the present ones."""
    return [r["result_id"] for r in result_rows(project).where("stale").select("result_id").distinct().orderBy("result_id").collect()]


def refit(project: Project, definition: dict) -> dict:
    """A definition calibrated again on its calibration spectra."""
    ids = definition.get("calibration_ids")
    if not ids:
        raise SpectrumError("the method doesn't name its calibration spectra")
    extra = {k: v for k, v in definition.items() if k in ("calibration_ids", "revision_of", "revision")}
    method = m.load({k: v for k, v in definition.items() if k not in extra})
    library = pl.Library.of(project.table("points"), getattr(method, "steps", []), getattr(method, "measurement", None))
    rows = project.spectra(ids)
    method = method.fit(rows, library) if isinstance(method, (m.Univariate, m.SignalEquations)) else method.fit(rows)
    return json.loads(json.dumps(method.definition())) | extra


def recalculate(project: Project, changed: list[int], mapping: dict[int, int] | None = None, reason: str = "recalculated") -> dict:
    """Refit methods and recompute results that depend on changed spectra; {old: new} and what was skipped, with reasons."""
    mapping = mapping or {}
    use = project.usage([*changed, *mapping])
    done: dict = {"methods": {}, "results": {}, "skipped": {}}
    for i in use["methods"]:
        definition = remap(json.loads(project.row("methods", i)["definition"]), mapping)
        try:
            done["methods"][i] = project.revise("methods", i, refit(project, definition), reason)
        except (SpectrumError, KeyError) as error:
            done["skipped"][f"method {i}"] = str(error)
    for i in use["results"]:
        row = project.row("results", i)
        method = done["methods"].get(row["method_id"], row["method_id"])
        data = remap(json.loads(row["data"]), mapping)
        if method is None:
            done["skipped"][f"result {i}"] = "it has no method"
            continue
        new = determine(project, method, data["ids"], row["name"])
        fresh = json.loads(project.row("results", new)["data"]) | {"excluded_ids": data.get("excluded_ids", [])}
        project.archive("results", [new], reason="superseded by a revision")
        done["results"][i] = project.revise("results", i, fresh, reason)
    return done


def checksum(document: dict) -> str:
    return hashlib.sha256(pl.canonical(document).encode()).hexdigest()


def export_model(project: Project, method_id: int) -> dict:
    """A calibrated method with the spectra it refers to, to be taken to another project."""
    row = project.row("methods", method_id)
    definition = json.loads(row["definition"])
    if not m.is_calibrated(definition):
        raise ProjectError("the method isn't calibrated")
    definition.pop("calibration_ids", None)
    embedded = {}
    for r in project.spectra(sorted(references(definition))).select("id", "name", "x", "y", "data_sha256").collect() if references(definition) else []:
        embedded[str(r["id"])] = {"name": r["name"], "x": r["x"], "y": r["y"], "data_sha256": r["data_sha256"]}
    return {"format": FORMAT, "name": row["name"], "definition": definition, "embedded": embedded, "sha256": checksum({"definition": definition, "embedded": embedded})}


def import_model(project: Project, document: dict, trial_id: int | None = None) -> int:
    if document.get("format") != FORMAT:
        raise ProjectError("not a model file")
    if document["sha256"] != checksum({"definition": document["definition"], "embedded": document["embedded"]}):
        raise ProjectError("the model file was altered")
    mapping = {int(i): project.add_spectrum(s["name"], s["x"], s["y"], role="reference") for i, s in document["embedded"].items()}
    return project.save_method(document["name"], remap(document["definition"], mapping), trial_id)


def flatten(value, prefix: str = "", most: int = 30) -> list[tuple[str, str]]:
    """A document as lines of path and value; long lists are cut for display."""
    if isinstance(value, dict):
        return [row for k, v in value.items() for row in flatten(v, f"{prefix}.{k}" if prefix else k, most)]
    if isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
        return [row for i, v in enumerate(value[:most]) for row in flatten(v, f"{prefix}[{i}]", most)]
    return [(prefix, pl.canonical(value[:most]) + (" ..." if len(value) > most else "") if isinstance(value, list) else str(value))]


def export_workbook(project: Project, path: str, result_ids: list[int] | None = None) -> None:
    """Index, methods, and a sheet for each result."""
    chosen = [r for r in project.results().collect() if result_ids is None or r["id"] in result_ids]
    index = [["id", "name", "kind", "method", "created"], *([r["id"], r["name"], r["kind"], r["method_id"], r["created_utc"]] for r in chosen)]
    lines = [["method", "field", "value"]]
    for i in sorted({r["method_id"] for r in chosen if r["method_id"] is not None}):
        row = project.row("methods", i)
        lines += [[row["name"], k, v] for k, v in flatten(json.loads(row["definition"]))]
    book = [("Index", index), ("Methods", lines)]
    for r in chosen:
        rows = result_rows(project, r["id"]).orderBy("spectrum_id", "compound")
        book.append((r["name"], [rows.columns, *(list(x) for x in rows.collect())]))
    with open(path, "wb") as f:
        f.write(sheets.write_xlsx(book))


def report(project: Project, trial_id: int | None = None, entries: int = 50) -> str:
    """A page with the state of the log, compounds, spectra, methods, results and the latest entries."""
    problems = project.verify()

    def table(title: str, df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
        return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"

    parts = [
        f"<h1>{html.escape(project.meta('name') or '')}</h1>",
        f"<p>{'The log and all points are intact.' if not problems else html.escape('; '.join(problems))}</p>",
        table("Compounds", project.current("compounds").select("name", "unit", "mw").orderBy("name")),
        table("Spectra", project.records(trial_id).select("id", "name", "kind", "role", "npoints")),
        table("Methods", project.methods(trial_id).select("id", "name", "type")),
        table("Results", result_summary(project).select("result_id", "compound", "n", "mean", "sd", "rsd").orderBy("result_id", "compound")),
        table("Log", project.audit(limit=entries).select("seq", "ts_utc", "user", "action", "entity", "summary", "reason")),
    ]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>{''.join(parts)}</body></html>"


#: Steps between amounts that are easy to prepare, times a power of ten.
STEPS = (1, 2, 2.5, 5, 10)


def round_levels(low: float, high: float, n: int) -> list[float]:
    """The range's ends and, between them, the multiples of a round step that are half a step from both.

    The step is the smallest that divides the range into n - 1 parts at most, so there may be
    fewer levels than n, or one more.
    """
    if n < 2 or not low < high:
        raise ValueError("levels need a range and two of them at least")
    part = (high - low) / (n - 1)
    power = 10.0 ** math.floor(math.log10(part))
    step = next(s * power for s in STEPS if s * power >= 0.999 * part)
    first, last = math.ceil(low / step + 0.5 - 1e-9), math.floor(high / step - 0.5 + 1e-9)
    return [float(f"{v:.3g}") for v in (low, *(k * step for k in range(first, last + 1)), high)]


def validation_plan(compound: str, low: float, high: float, target: float, levels: int = 6, replicates: int = 3, steps: list[dict] = ()) -> list[dict]:
    """Experiments that a validation of a method needs, with the amounts to prepare."""
    digits = 2 - int(math.floor(math.log10(max(abs(high - low), 1e-12))))
    amounts = round_levels(low, high, levels)
    plan = [{"test": "linearity", "compound": compound, "amounts": amounts, "replicates": replicates}]
    plan += [{"test": f"accuracy {p} %", "compound": compound, "amounts": [round(target * p / 100, max(0, digits))], "replicates": replicates} for p in (80, 100, 120)]
    plan += [{"test": "repeatability", "compound": compound, "amounts": [target], "replicates": 6}, {"test": "intermediate precision", "compound": compound, "amounts": [target], "replicates": 6}]
    for s in steps:
        if s["op"] == "derivative" and s["params"].get("method") == "savitzky_golay":
            plan.append({"test": "robustness: filter window", "compound": compound, "amounts": [target], "replicates": 1})
        plan.append({"test": f"robustness: {s['op']}", "compound": compound, "amounts": [target], "replicates": 1})
    return plan
