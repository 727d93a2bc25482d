"""The cleaning sequence (I12) as a plan of DataFrame steps.

The reference walks a user through a fixed order with a skip at each step:

    auto clean -> (find) / remove duplicates -> (suggest) / convert types
      -> impute NULLs -> drop columns -> export

``CleaningPlan`` holds that list; ``run`` applies it with ``df.transform``
and returns the final frame and the log. Steps that only *look* at data
(finding duplicates, suggesting types) are reports, not steps.

The steps after duplicate removal run several small actions on its result
(suggestions, the conversion report, NULL counts, statistics). So that the
duplicate shuffle runs once, the plan materialises that result:
``materialize="checkpoint"`` (default) writes it with ``df.checkpoint()`` to the
cluster's shared ``spark.checkpoint.dir`` and cuts the lineage, so a lost
executor restarts from the written copy and nothing stays on executor disks;
``"persist"`` caches it (memory, spilling to disk; a lost block is recomputed from
lineage) until :meth:`CleaningPlan.release`; ``None`` recomputes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation

from ..operators.clean import auto_clean_with_log, drop_columns, drop_columns_log
from pyspark.sql import functions as F

from ..functions.casts import guarded_cast, text_to_double, type_label
from ..functions.columns import is_numeric, is_text, nan_to_null, qcol
from ..operators.convert import SUGGEST_THRESHOLD, SUGGEST_TO, _plan, convert_types
from ..operators.dedup import remove_duplicates
from ..operators.impute import (MEAN_DEFAULT_TYPES, fill_nulls, imputation_values,
                                mode_values)
from ..session import ensure_checkpoint_dir

# Step names in the order the flow runs them.
STEPS = ("auto_clean", "remove_duplicates", "convert_types", "impute_nulls", "drop_columns")
SKIP = "skip"
AUTO = "auto"


@dataclass
class CleaningPlan:
    """Each field is either a value for the step, ``"skip"``, or (for
    conversions and imputations) ``"auto"`` to take the suggested plan."""
    auto_clean: dict | str | None = field(default_factory=dict)
    remove_duplicates: str | None = "remove_exact_duplicates"
    convert_types: list | str | None = AUTO
    impute_nulls: list | str | None = AUTO
    drop_columns: list | str | None = SKIP
    materialize: str | None = "checkpoint"
    checkpoint: bool = False          # same as materialize="checkpoint"
    _held: list = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Unpersist frames cached by :meth:`run`."""
        for frame in self._held:
            frame.unpersist()
        self._held.clear()

    def run(self, df: DataFrame):
        """Apply the steps in order; returns ``(frame, log)``. The log is a
        list of ``(step, message)``."""
        log: list[tuple[str, str]] = []
        cur = df

        mode = "checkpoint" if self.checkpoint else self.materialize
        if mode not in ("persist", "checkpoint", None):
            raise ValueError("materialize must be 'persist', 'checkpoint' or None")
        if mode == "checkpoint":
            ensure_checkpoint_dir(df.sparkSession)

        def cut(frame):
            if mode == "checkpoint":
                return frame.checkpoint(eager=True)
            if mode == "persist":
                held = frame.persist(StorageLevel.MEMORY_AND_DISK)
                self._held.append(held)
                return held
            return frame

        if self.auto_clean not in (SKIP, None):
            cur, msgs = auto_clean_with_log(cur, **(self.auto_clean or {}))
            log += [("auto_clean", m) for m in msgs]
        else:
            log.append(("auto_clean", SKIP))

        do_convert = self.convert_types not in (SKIP, None)
        do_impute = self.impute_nulls not in (SKIP, None)
        asked = (self.convert_types if do_convert else [], self.impute_nulls == AUTO)
        survey = None
        if self.remove_duplicates not in (SKIP, None):
            cur = remove_duplicates(cur, self.remove_duplicates)
            questions = _questions(cur, *asked) if mode == "checkpoint" and (do_convert or do_impute) else None
            if questions and questions.aggs:  # answered while the checkpoint is written
                seen = Observation()
                cur = cut(cur.observe(seen, *questions.aggs))
                survey = _survey(cur, *asked, questions, seen.get)
            else:
                cur = cut(cur)
            log.append(("remove_duplicates", "All exact duplicate rows have been removed."))
        else:
            log.append(("remove_duplicates", SKIP))

        if survey is None and (do_convert or do_impute):
            survey = _survey(cur, *asked)

        if do_convert:
            convs, report = survey["conversions"], survey["report"]
            if convs:
                cur = convert_types(cur, convs)
            for c, status, typ, fails, err in report:
                log.append(("convert_types", f"{c}: {status} -> {typ}"
                            + (f" ({fails} failures)" if status == "Success" else f" ({err})")))
            if not report:
                log.append(("convert_types", "no conversions"))
        else:
            log.append(("convert_types", SKIP))

        if do_impute:
            if self.impute_nulls == AUTO:
                values = survey["mean_values"]
                plan = survey["imputations"]
                modes = [c for c, strat in plan if strat == "mode"]
                values = {c: ("mean", values[c]) for c, strat in plan if strat == "mean"}
                if modes:
                    values.update({c: ("mode", v) for c, v in mode_values(cur, modes).items()})
                values = {c: values[c] for c, _ in plan}
            else:
                values = imputation_values(cur, self.impute_nulls)
            cur, msgs = fill_nulls(cur, values)
            log += [("impute_nulls", m) for m in msgs] or [("impute_nulls", "nothing to impute")]
        else:
            log.append(("impute_nulls", SKIP))

        if self.drop_columns not in (SKIP, None):
            cur = drop_columns(cur, self.drop_columns)
            log.append(("drop_columns", drop_columns_log(self.drop_columns)["message"]))
        else:
            log.append(("drop_columns", SKIP))
        return cur, log


@dataclass
class _Questions:
    """Aggregates over the de-duplicated table, the key of each, and the valid and the
    failing explicit conversions."""
    keys: list
    aggs: list
    valid: dict
    errors: dict


def _questions(frame: DataFrame, conversions, auto_impute: bool) -> _Questions:
    """What the conversion and imputation steps ask of the de-duplicated table: which
    text columns to convert (``"auto"``) or how many values an explicit conversion
    loses, the NULL counts after conversion, and the mean of every column that is
    numeric after conversion."""
    fields = frame.schema.fields
    texts = [f.name for f in fields if is_text(f.dataType)]
    auto = conversions == AUTO
    aggs, keys = [], []

    def add(key, expr):
        keys.append(key)
        aggs.append(expr.alias(f"a{len(aggs)}"))

    if auto:
        for c in texts:
            x = qcol(c)
            add(("ok", c), F.count_if(text_to_double(x).isNotNull()))
            add(("ne", c), F.count_if(x.isNotNull() & (x != "")))
            add(("nn", c), F.count(x))
        valid, errors = {}, {}
    else:
        valid, errors = _plan(frame, conversions)
        for c, (_, target) in valid.items():
            src = qcol(c)
            cast = guarded_cast(src, frame.schema[c].dataType, target)
            add(("fail", c), F.count_if(src.isNotNull() & cast.isNull()))
    if auto_impute:
        for f in fields:
            add(("null", f.name), F.count_if(qcol(f.name).isNull()))
            # mean after a possible conversion: numeric now, or text that may
            # become DOUBLE, or an explicit numeric target
            if auto and is_text(f.dataType):
                add(("mean", f.name), F.avg(F.when(~F.isnan(text_to_double(qcol(f.name))),
                                                   text_to_double(qcol(f.name)))))
            elif f.name in valid and is_numeric(valid[f.name][1]):
                cast = guarded_cast(qcol(f.name), f.dataType, valid[f.name][1])
                add(("mean", f.name), F.avg(nan_to_null_expr(cast, valid[f.name][1])))
            elif f.name not in valid and is_numeric(f.dataType):
                add(("mean", f.name), F.avg(nan_to_null(f.name, f.dataType)))
    return _Questions(keys, aggs, valid, errors)


def _survey(frame: DataFrame, conversions, auto_impute: bool, questions: _Questions | None = None,
            answers: dict | None = None) -> dict:
    """The conversion and imputation plans of ``frame`` (the de-duplicated table), from one
    aggregation, or from ``answers`` that were taken while the frame was written. The
    rules are those of ``suggest_types``, ``conversion_report`` and ``suggest_imputations``."""
    q = questions or _questions(frame, conversions, auto_impute)
    if answers is None:
        answers = frame.agg(*q.aggs).first().asDict() if q.aggs else {}
    got = {k: answers[f"a{i}"] for i, k in enumerate(q.keys)}
    texts = [f.name for f in frame.schema.fields if is_text(f.dataType)]
    auto, valid, errors = conversions == AUTO, q.valid, q.errors

    report, convs, fails = [], [], {}
    if auto:
        for c in texts:
            ok, ne, nn = got[("ok", c)], got[("ne", c)], got[("nn", c)]
            if ne > 0 and ok / ne > SUGGEST_THRESHOLD:
                convs.append((c, SUGGEST_TO))
                fails[c] = nn - ok
                report.append((c, "Success", SUGGEST_TO, nn - ok, None))
    else:
        for c, (typ, _) in valid.items():
            convs.append((c, typ))
            fails[c] = got[("fail", c)]
            report.append((c, "Success", typ, got[("fail", c)], None))
        report += [(c, "Failed", typ, None, err) for c, (typ, err) in errors.items()]

    out = {"conversions": convs, "report": report}
    if auto_impute:
        converted = convert_types(frame, convs).schema
        plan, means = [], {}
        for f in converted.fields:
            nulls = got[("null", f.name)] + fails.get(f.name, 0)
            if nulls > 0:
                plan.append((f.name, "mean" if type_label(f.dataType) in MEAN_DEFAULT_TYPES
                             else "mode"))
            if is_numeric(f.dataType):
                means[f.name] = got.get(("mean", f.name))
        out["imputations"] = plan
        out["mean_values"] = means
    return out


def nan_to_null_expr(x, dt):
    from ..functions.columns import is_floating
    return F.when(~F.isnan(x), x) if is_floating(dt) else x
