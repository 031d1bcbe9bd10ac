"""Directional routing of conversation turns.

Doctor turns go English -> patient language and are classified; the ones
classified as domain text are rewritten in plain words before translation.
Patient turns go patient language -> English and are only translated.
``process_turns`` is the whole flow as one DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.text import is_nonblank, py_strip
from parley.operators import classifier, infer, langs, rewrite, translate
from parley.session import cut_lineage

EN = fv.HIGH_RESOURCE_LANG


def speaker_of(role) -> F.Column:
    """assistant -> doctor, user -> patient (system rows are neither)."""
    return (F.when(role == "assistant", F.lit("doctor"))
            .when(role == "user", F.lit("patient")))


def turn_requests(conversations: DataFrame, simplify_mode: str | None = "local",
                  translate_mode: str | None = "local") -> DataFrame:
    """Turn requests from the conversation table: speaker, patient language
    (looked up by name), direction, and the two backend modes. Blank turns are
    skipped, as the chat does. A mode of None derives a per-conversation mode
    (api / local / other) to exercise backend resolution."""
    c = (conversations.where(F.col("role").isin("assistant", "user"))
         .where(is_nonblank(F.col("text")))
         .select("conv_id", "turn", speaker_of(F.col("role")).alias("speaker"), "text",
                 langs.patient_language(F.col("conv_id")).alias("lang_name")))
    c = langs.lookup_codes(c, "lang_name", strict=True)
    doctor = F.col("speaker") == "doctor"
    modes = F.array(F.lit("api"), F.lit("local"), F.lit("other"))
    sm = (F.lit(simplify_mode) if simplify_mode is not None
          else F.element_at(modes, (F.pmod(F.col("conv_id"), F.lit(3)) + 1).cast("int")))
    tm = (F.lit(translate_mode) if translate_mode is not None
          else F.element_at(modes, (F.pmod(F.col("conv_id") + 1, F.lit(3)) + 1).cast("int")))
    return c.select(
        "conv_id", "turn", "speaker", "text", "lang_name",
        F.when(doctor, F.lit(EN)).otherwise(F.col("lang_code")).alias("src_lang"),
        F.when(doctor, F.col("lang_code")).otherwise(F.lit(EN)).alias("tgt_lang"),
        sm.alias("simplify_mode"), tm.alias("translate_mode"))


def document_requests(documents: DataFrame) -> DataFrame:
    """Documents as requests: English ones go to a patient language (by id,
    like conversations), the others go to English. Codes by broadcast join."""
    d = documents.select("doc_id", "text", "lang")
    codes = F.broadcast(langs.doc_lang_table(documents.sparkSession)
                        .withColumnRenamed("lang_code", "src_lang"))
    d = d.join(codes, "lang", "left")
    low = langs.lookup_codes(d.withColumn("lang_name", langs.patient_language(F.col("doc_id"))),
                             "lang_name")
    en = F.col("src_lang") == EN
    return low.select("doc_id", "text", "lang", "src_lang",
                      F.when(en, F.col("lang_code")).otherwise(F.lit(EN)).alias("tgt_lang"))


def gate(df: DataFrame) -> DataFrame:
    """Classification and rewriting switch on when the source is English; the
    target is not looked at."""
    return df.withColumn("gated", F.coalesce(F.col("src_lang") == F.lit(EN), F.lit(False)))


def classify_gated(reqs: DataFrame, model: classifier.LinearTextModel) -> DataFrame:
    """Score the gated rows; other rows carry null margin / medical / confidence.
    One map over all rows, so no row depends on its keys."""
    g = gate(reqs)
    scored = classifier.classify(g.withColumn("_gated_text", F.when(F.col("gated"), F.col("text"))), model, "_gated_text")
    return scored.select(*g.columns, *[F.when(F.col("gated"), F.col(c)).alias(c) for c in ("margin", "medical", "confidence")])


def apply_simplify(df: DataFrame, mode: str = "local") -> DataFrame:
    """Rewrite gated, domain-positive rows; others get null. Backend output is
    trimmed (Python ``strip`` whitespace). The working text is the rewrite when
    there is one (an empty rewrite still wins), else the original."""
    chosen = F.col("gated") & F.coalesce(F.col("medical"), F.lit(False))
    backend = infer.resolve_simplify(mode)
    if backend == "glossary":
        df = (df.withColumn("simplified", F.when(chosen, py_strip(rewrite.rewrite(F.col("text")))))
              .withColumn("simplify_error", F.lit(None).cast("string")))
    else:
        backend.check()
        todo = df.where(chosen).withColumn("_src", F.lit(EN)).withColumn("_tgt", F.lit(EN))
        done = infer.run_backend(todo, backend, "_src", "_tgt", "text", "simplified", "simplify_error")
        done = done.withColumn("simplified", py_strip(F.col("simplified")))
        rest = (df.where(~chosen).withColumn("simplified", F.lit(None).cast("string"))
                .withColumn("simplify_error", F.lit(None).cast("string")))
        df = done.drop("_src", "_tgt").unionByName(rest)
    return df.withColumn("working", F.when(chosen, F.col("simplified")).otherwise(F.col("text")))


def apply_translate(df: DataFrame, mode: str = "local") -> DataFrame:
    """Translate the working text of rows whose earlier steps did not fail."""
    backend = infer.resolve_translate(mode)
    ok = df.withColumn("_tx", F.when(F.col("simplify_error").isNull(), F.col("working")))
    if backend == "phrases":
        out = translate.translated(ok, "src_lang", "tgt_lang", "_tx", "translation", "translate_error")
    else:
        out = infer.run_backend(ok, backend, "src_lang", "tgt_lang", "_tx",
                                "translation", "translate_error")
    return (out.withColumn("error", F.coalesce("simplify_error", "translate_error"))
            .drop("_tx", "simplify_error", "translate_error"))


def _row_modes(reqs: DataFrame, simplify_mode, translate_mode) -> tuple[list, list]:
    """The modes to run each step in: the given one, or the distinct backends
    (at most two) that the rows' mode columns resolve to."""
    given = [[m or "local"] for m in (simplify_mode, translate_mode)]
    names = (infer.simplify_backend_name, infer.translate_backend_name)
    todo = {i: names[i](F.col(c)) for i, (m, c) in enumerate(
        ((simplify_mode, "simplify_mode"), (translate_mode, "translate_mode")))
        if m is None and c in reqs.columns}
    if todo:
        found = reqs.select(*[F.sort_array(F.collect_set(e)).alias(f"m{i}") for i, e in todo.items()]).first()
        for i in todo:
            given[i] = found[f"m{i}"] or ["local"]
    return given[0], given[1]


def _per_mode(df: DataFrame, modes: list, name: F.Column, step) -> DataFrame:
    """``step(rows, mode)`` on the rows of each mode, put together again."""
    if len(modes) == 1:
        return step(df, modes[0])
    df = cut_lineage(df, "turns")    # read once a mode
    parts = [step(df.where(name == m), m) for m in modes]
    return parts[0].unionByName(parts[1])


def process_turns(reqs: DataFrame, model: classifier.LinearTextModel,
                  simplify_mode=None, translate_mode=None,
                  id_cols=("conv_id", "turn")) -> DataFrame:
    """gate -> classify -> rewrite -> translate -> step record.

    A mode of None obeys each row's ``simplify_mode`` / ``translate_mode``
    column ('local' where there is none). The credentials of all backends in
    use are checked before any step runs."""
    s_modes, t_modes = _row_modes(reqs, simplify_mode, translate_mode)
    for backend in [infer.resolve_simplify(m) for m in s_modes] + [infer.resolve_translate(m) for m in t_modes]:
        if isinstance(backend, infer.Backend):
            backend.check()
    df = classify_gated(reqs, model)
    df = _per_mode(df, s_modes, infer.simplify_backend_name(F.col("simplify_mode")), apply_simplify)
    df = _per_mode(df, t_modes, infer.translate_backend_name(F.col("translate_mode")), apply_translate)
    return df.select(*id_cols, *[c for c in ("speaker",) if c in df.columns],
                     "src_lang", "tgt_lang", F.col("text").alias("original"),
                     "medical", "confidence",
                     "simplified", "translation", "error")
