"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them) in
full. Floating results are rounded to 6 decimals so the DuckDB oracle can be
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions import text as tx
from parley.operators import (alignment, audit, classifier, corpus, evaluate, features, heavy, infer, langs, lattice,
                              rewrite, route, sampling, svm, transcript, translate)
from parley.session import cut_lineage
from parley.sources import tables


def _r(c: str, nd: int = 6):
    return F.round(F.col(c), nd).alias(c)


# -- shared derivations --------------------------------------------------------

def _corpus(spark, sf) -> DataFrame:
    return corpus.corpus_build(tables.documents(spark, sf), tables.conversations(spark, sf))


def _split(spark, sf) -> DataFrame:
    c = corpus.reusable_corpus(tables.documents(spark, sf), tables.conversations(spark, sf))
    return sampling.training_split(c)


def _requests(spark, sf, **kw) -> DataFrame:
    return route.turn_requests(tables.conversations(spark, sf), **kw)


def _processed(spark, sf) -> DataFrame:
    return route.process_turns(_requests(spark, sf), classifier.demo_model(spark), "local", "local")


def _demo_predictions(spark, sf) -> DataFrame:
    test = _split(spark, sf).where(F.col("split") == "test")
    s = classifier.classify(test, classifier.demo_model(spark))
    return s.withColumn("prediction", F.col("medical").cast("int"))


def _transcript(spark, sf) -> DataFrame:
    conv = tables.conversations(spark, sf)
    return transcript.transcript(_processed(spark, sf), transcript.chat_events(conv))


# -- 2.1 / 2.2 / 2.6 corpus ----------------------------------------------------

def q_filter_nonempty(spark, sf):
    return corpus.positive_corpus(tables.documents(spark, sf))


def q_extract_user_text(spark, sf):
    return corpus.user_text_flat(tables.conversations(spark, sf))


def q_extract_user_text_nested(spark, sf):
    d = corpus.dialogues_of(tables.conversations(spark, sf))
    return corpus.user_text_nested(d).select(F.col("id").alias("conv_id"), "text")


def q_extract_user_text_jsonl(spark, sf):
    """The same from nested JSON-lines files, which Spark writes first."""
    import uuid
    from parley.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/dialogues-{uuid.uuid4().hex}"
    corpus.dialogues_of(tables.conversations(spark, sf)).write.json(path)
    good, _ = tables.read_dialogues(spark, path)
    return corpus.user_text_nested(good).select(F.col("id").alias("conv_id"), "text")


def q_filter_nonblank(spark, sf):
    c = tables.conversations(spark, sf)
    return c.where(tx.is_nonblank(F.col("text")))


def q_corpus_build(spark, sf):
    return _corpus(spark, sf)


def q_class_counts(spark, sf):
    return corpus.class_counts(_corpus(spark, sf))


def q_balanced_sample(spark, sf):
    c = corpus.reusable_corpus(tables.documents(spark, sf), tables.conversations(spark, sf))
    return sampling.balanced_sample(c).select("source", "id", "label")


def q_stratified_split(spark, sf):
    return _split(spark, sf).select("source", "id", "label", "split")


def q_class_weights(spark, sf):
    train = _split(spark, sf).where(F.col("split") == "train")
    return corpus.class_weights(train).select("label", "n_class", _r("weight"))


# -- 2.7 scalar text functions -------------------------------------------------

def q_tokens(spark, sf):
    d = tables.documents(spark, sf, spread_rows=True)
    t = tx.tokens(F.col("text"))
    return d.select("doc_id", tx.let(t, lambda u: F.struct(
        F.size(u).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(u)).cast("long").alias("n_distinct"))).alias("s")).select("doc_id", "s.*")


def q_ngrams(spark, sf):
    d = tables.documents(spark, sf, spread_rows=True)
    return d.select("doc_id", tx.let(tx.terms(F.col("text")), lambda u: F.struct(
        F.size(u).cast("long").alias("n_terms"),
        F.size(F.array_distinct(u)).cast("long").alias("n_distinct_terms"))).alias("s")).select("doc_id", "s.*")


def q_html_escape(spark, sf):
    c = tables.conversations(spark, sf)
    return c.select("conv_id", "turn", tx.html_escape(F.col("text")).alias("escaped"))


def q_prompt_build(spark, sf):
    reqs = route.gate(_requests(spark, sf)).where(F.col("gated"))
    m = reqs.select("conv_id", "turn", F.posexplode(tx.chat_messages(F.col("text"))).alias("msg_idx", "m"))
    return m.select("conv_id", "turn", F.col("msg_idx").cast("long").alias("msg_idx"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_turn_tags(spark, sf):
    p = _processed(spark, sf).where(F.col("speaker") == "doctor")
    return p.select("conv_id", "turn", tx.tag(F.col("medical"), F.col("confidence")).alias("tag"))


# -- 2.4 / 2.5 features --------------------------------------------------------

def _train(spark, sf):
    return _split(spark, sf).where(F.col("split") == "train")


def q_term_stats(spark, sf):
    return features.term_stats(_train(spark, sf))


def q_vocab_topk(spark, sf):
    return features.vocab_topk(features.term_stats(_train(spark, sf)))


def q_vocab_topk_two_pass(spark, sf):
    """The same vocabulary by summaries first: only terms that may be in it are shuffled."""
    return heavy.vocab_topk(cut_lineage(_train(spark, sf)))


def q_idf_table(spark, sf):
    train = cut_lineage(_train(spark, sf))
    idf = features.idf_table(features.vocab_topk(features.term_stats(train)), train.count())
    return idf.select("term", "df", _r("idf"))


def q_tfidf(spark, sf):
    split = cut_lineage(_split(spark, sf))
    train = split.where(F.col("split") == "train")
    idf = features.idf_table(features.vocab_topk(features.term_stats(train)), train.count())
    test = split.where(F.col("split") == "test")
    return features.tfidf(test, ["source", "id"], "text", idf.select("term", "idf")).select(
        "source", "id", "term", _r("weight"))


# -- 2.3 / 2.8 scoring and evaluation -----------------------------------------

def q_svm_score(spark, sf):
    d = tables.documents(spark, sf, spread_rows=True).select("doc_id", "text")
    return classifier.margins(d, ["doc_id"], classifier.demo_model(spark)).select("doc_id", _r("margin"))


def q_classify_turns(spark, sf):
    reqs = route.gate(_requests(spark, sf)).where(F.col("gated"))
    c = classifier.classify(reqs, classifier.demo_model(spark))
    return c.select("conv_id", "turn", _r("margin"), "medical", _r("confidence"))


def q_eval_metrics(spark, sf):
    m = evaluate.eval_metrics(_demo_predictions(spark, sf))
    return m.select("n", *[_r(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


def q_confusion(spark, sf):
    return evaluate.confusion(_demo_predictions(spark, sf))


def q_misclassified(spark, sf):
    return evaluate.misclassified(_demo_predictions(spark, sf))


def _svm_path(spark, sf) -> str:
    """Model directory keyed by the training tables' files (path, size, time) and the vocabulary size."""
    import hashlib
    files = tables.file_versions(spark, sf, "documents", "conversations")
    key = hashlib.sha256(repr((files, features.MAX_FEATURES)).encode()).hexdigest()[:16]
    return classifier.model_path(spark, f"svm-{key}")


def q_svm_train_eval(spark, sf):
    """Train TF-IDF + linear SVM on the training split, save, reload, and
    evaluate the reloaded model on the test split (model form)."""
    split = cut_lineage(_split(spark, sf))
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    pm, table = classifier.train_svm(train)
    path = _svm_path(spark, sf)
    classifier.save_model(pm, table, path)
    pm2, table2 = classifier.load_model(spark, path)
    preds = cut_lineage(classifier.predict(pm2, test).select("source", "id", "label", "prediction", "margin"))
    keys = ["source", "id"]
    by_table = classifier.margins_joined(test, keys, table2).withColumnRenamed("margin", "by_table")
    same = (preds.join(by_table, keys).agg(
        F.coalesce(F.max(F.abs(F.col("margin") - F.col("by_table"))) < 1e-6, F.lit(True)).alias("paths_agree")))
    m = evaluate.eval_metrics(preds).select(
        F.col("n").alias("n_test"), (F.col("accuracy") > 0.5).alias("beats_chance"),
        F.col("macro_f1").between(0.0, 1.0).alias("f1_in_range"))
    fit = F.lit(train.count()).alias("n_train"), F.lit(table2.n_terms).cast("long").alias("n_terms")
    return m.crossJoin(F.broadcast(same)).select(*fit, "*")      # two one-row tables


def q_svm_gradient(spark, sf):
    """The solver's first pass over the training split: per vocabulary term the loss's
    gradient and the Hessian's diagonal where all weights are 0."""
    train = cut_lineage(_train(spark, sf))
    vocab, idf = features.fit_vocabulary(train, n_docs=train.count())
    weights = F.broadcast(corpus.class_weights(train).select("label", "weight"))     # a row for each class
    gradient, diagonal = svm.first_pass(svm.blocks(train.join(weights, "label"), vocab, idf), len(vocab))
    rows = zip(vocab, gradient.tolist(), diagonal.tolist())
    return spark.createDataFrame(list(rows), "term string, gradient double, curvature double").select(
        "term", _r("gradient"), _r("curvature"))


# -- 2.2 / 2.3 routing -----------------------------------------------------------

def q_direction_gate(spark, sf):
    return route.gate(_requests(spark, sf)).select("conv_id", "turn", "speaker", "src_lang",
                                                   "tgt_lang", "gated")


def q_lang_lookup(spark, sf):
    c = tables.conversations(spark, sf).select("conv_id").distinct()
    c = c.withColumn("lang_name", langs.patient_language(F.col("conv_id")))
    return langs.lookup_codes(c, "lang_name").select("conv_id", "lang_name", "lang_code")


def q_lang_unknown(spark, sf):
    d = route.document_requests(tables.documents(spark, sf))
    return langs.unknown_codes(d.select("doc_id", "lang", "src_lang"), "src_lang")


def q_backend_route(spark, sf):
    r = _requests(spark, sf, simplify_mode=None, translate_mode=None)
    return r.select("conv_id", "turn", "simplify_mode", "translate_mode",
                    infer.simplify_backend_name(F.col("simplify_mode")).alias("simplify_backend"),
                    infer.translate_backend_name(F.col("translate_mode")).alias("translate_backend"))


def q_working_text(spark, sf):
    df = route.apply_simplify(route.classify_gated(_requests(spark, sf), classifier.demo_model(spark)))
    return df.select("conv_id", "turn", "working")


def q_turn_steps(spark, sf):
    p = _processed(spark, sf)
    return p.select("conv_id", "turn", "src_lang", "tgt_lang", "original", "medical",
                    _r("confidence"), "simplified", "translation")


def q_process_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every chat turn through gate -> classify -> rewrite -> translate."""
    out = _processed(spark, sf)
    return out.select("conv_id", "turn", "speaker", "src_lang", "tgt_lang", "original",
                      "medical", _r("confidence"), "simplified", "translation", "error")


# -- 2.3 J5 / 2.9 backends ----------------------------------------------------

def q_glossary_simplify(spark, sf):
    d = tables.documents(spark, sf, spread_rows=True).where(F.col("lang") == "en")
    r = d.select("doc_id", rewrite.rewrite_counted(F.col("text")).alias("r"))
    return r.select("doc_id", F.col("r.n").alias("n_replaced"), F.col("r.text").alias("simplified"))


def q_glossary_simplify_joined(spark, sf):
    """The same rewrite through the join path used beyond the compiled-table
    bound (the glossary given as a table)."""
    d = tables.documents(spark, sf, spread_rows=True).where(F.col("lang") == "en").select("doc_id", "text")
    table = spark.createDataFrame(fv.GLOSSARY, "term string, plain string")
    return rewrite.rewrite_joined(d, "text", table, "simplified").select("doc_id", "simplified")


def q_simplify_turns(spark, sf):
    p = _processed(spark, sf).where(F.col("simplified").isNotNull())
    return p.select("conv_id", "turn", "simplified")


def q_translate_turns(spark, sf):
    return _processed(spark, sf).select("conv_id", "turn", "src_lang", "tgt_lang",
                                        "translation", "error")


def _translated_documents(spark, sf):
    d = route.document_requests(tables.documents(spark, sf, spread_rows=True))
    return translate.translated(d, "src_lang", "tgt_lang", "text", "translation", "error")


def q_translate_documents(spark, sf):
    return _translated_documents(spark, sf).select("doc_id", "src_lang", "tgt_lang",
                                                   "translation", "error")


def q_translate_documents_joined(spark, sf):
    """The same by the join on (src, tgt, phrase), for phrase tables of any size."""
    d = route.document_requests(tables.documents(spark, sf, spread_rows=True))
    t = translate.translate_joined(d, "src_lang", "tgt_lang", "text", "translation", "error",
                                   translate.phrase_table(spark))
    return t.select("doc_id", "src_lang", "tgt_lang", "translation", "error")


def q_translate_lattice(spark, sf):
    """Turn requests by the best path of their phrase lattice; the English bigrams are
    those of the English documents."""
    english = tables.documents(spark, sf, spread_rows=True).where(F.col("lang") == "en")
    bigrams = cut_lineage(lattice.bigram_scores(english, fv.HIGH_RESOURCE_LANG), "bigrams")
    out = lattice.translated(_requests(spark, sf), "src_lang", "tgt_lang", "text",
                             lattice.entries(translate.phrase_table(spark)), bigrams)
    return out.select("conv_id", "turn", "src_lang", "tgt_lang", "translation", "path_score", "truncated", "error")


def q_turn_errors(spark, sf):
    """Failing requests: documents sent to the language that their lang column
    names, from a patient language that the model may not know."""
    d = route.document_requests(tables.documents(spark, sf, spread_rows=True))
    d = d.withColumn("tgt_lang", F.when(F.col("lang") == "en", F.col("tgt_lang")).otherwise(F.col("lang")))
    t = translate.translated(d, "src_lang", "tgt_lang", "text", "translation", "error")
    return t.where(F.col("error").isNotNull()).select("doc_id", "src_lang", "tgt_lang", "error")


# -- 2.10 audits ----------------------------------------------------------------

def _doc_rewrites(spark, sf):
    d = tables.documents(spark, sf, spread_rows=True).where(F.col("lang") == "en")
    return d.select("doc_id", "text", rewrite.rewrite(F.col("text")).alias("simplified"))


def q_audit_negation(spark, sf):
    a = audit.negation(_doc_rewrites(spark, sf), "text", "simplified")
    return a.drop("text", "simplified")


def q_audit_numbers(spark, sf):
    a = audit.number_check(_doc_rewrites(spark, sf), "text", "simplified")
    return a.drop("text", "simplified")


def q_audit_alignment(spark, sf):
    """What each negation governs, and words that nothing licenses, in the rewrites."""
    a = alignment.audit(_doc_rewrites(spark, sf), "text", "simplified")
    return a.select("doc_id", "negations", "negations_lost", "negations_moved", "added_words")


def q_audit_alignment_cut(spark, sf):
    """The same where an output lost the second half of its source's sentences."""
    d = tables.documents(spark, sf, spread_rows=True).where(F.col("lang") == "en")
    parts = F.split("text", r"[.]")
    d = d.withColumn("cut", F.array_join(F.slice(parts, 1, F.ceil(F.size(parts) / 2).cast("int")), "."))
    return alignment.audit(d, "text", "cut").select("doc_id", "negations", "negations_lost", "negations_moved", "added_words")


def q_audit_script(spark, sf):
    t = _processed(spark, sf).select("conv_id", "turn", "tgt_lang", "translation")
    lt = langs.lang_table(spark).select(F.col("lang_code").alias("tgt_lang"), "script")
    t = t.join(F.broadcast(lt), "tgt_lang", "left")
    a = audit.script_share(t, "translation", "script")
    return a.select("conv_id", "turn", "tgt_lang", "script", "letters", "in_script", _r("script_share"))


def q_audit_length(spark, sf):
    t = _processed(spark, sf).select("conv_id", "turn", "original", "translation")
    a = audit.length_check(t, "original", "translation", fv.TRANSLATE_MAX_LENGTH)
    return a.select("conv_id", "turn", "words_src", "words_out", _r("length_ratio"),
                    "empty_output", "at_cap")


def q_audit_length_rewrite(spark, sf):
    """Length audit of the rewrites, against the rewriting backend's cap."""
    a = audit.length_check(_doc_rewrites(spark, sf), "text", "simplified", fv.SIMPLIFY_MAX_NEW_TOKENS)
    return a.select("doc_id", "words_src", "words_out", _r("length_ratio"), "empty_output", "at_cap")


# -- 2.12 / 2.5 transcripts --------------------------------------------------

def q_turn_numbers(spark, sf):
    ev = transcript.chat_events(tables.conversations(spark, sf))
    return transcript.number_turns(ev).select("conv_id", "turn", "turn_no")


def q_conversation_epochs(spark, sf):
    ev = transcript.chat_events(tables.conversations(spark, sf))
    return transcript.number_turns(ev).select("conv_id", "turn", "epoch", "turn_no")


def q_bilingual_views(spark, sf):
    return _transcript(spark, sf)


def q_panel_history(spark, sf):
    return transcript.panel_history(_transcript(spark, sf))


def q_bilingual_pairs(spark, sf):
    return transcript.bilingual_pairs(_transcript(spark, sf))


def q_turn_append(spark, sf):
    """Processed turns appended to a turn table in two commits (doctor turns,
    then patient turns) and read back."""
    import uuid
    from parley.session import checkpoint_dir
    from parley.sources import sinks
    p = _processed(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/turns-{uuid.uuid4().hex}"
    for speaker in ("doctor", "patient", "doctor"):           # the third is a replay and adds nothing
        sinks.append_turns(p.where(F.col("speaker") == speaker), path, commit_id=speaker)
    out = sinks.read_turns(p, path)
    return out.select("conv_id", "turn", "speaker", "src_lang", "tgt_lang", "original",
                      "medical", _r("confidence"), "simplified", "translation", "error")


# -- 2.11 streaming -------------------------------------------------------------

def _trained_model(spark, sf):
    """The SVM for this table set: loaded from the model directory when one
    was saved (training and inference are separate steps), else trained on
    the training split and saved."""
    path = _svm_path(spark, sf)
    try:
        return classifier.load_model(spark, path)
    except FileNotFoundError:
        split = cut_lineage(_split(spark, sf))
        pm, table = classifier.train_svm(split.where(F.col("split") == "train"))
        classifier.save_model(pm, table, path)
        return pm, table

def q_stream_turn_numbers(spark, sf):
    from parley.streaming import turns
    return turns.stream_turn_numbers(spark, sf).select("conv_id", "turn", "epoch", "turn_no")


def q_stream_score_turns(spark, sf):
    """Arriving doctor turns scored by the trained model in a plain (map-only,
    append-mode) stream: per turn, whether the batch form of the same model gives the
    margin, the label is its sign, and the confidence lies in its range."""
    from parley.streaming import turns
    pm, table = _trained_model(spark, sf)
    out = turns.run_to_table(turns.score_stream(turns.read_stream(spark, sf), pm), spark, "score")
    keys = ["conv_id", "turn"]
    batch = classifier.margins_joined(tables.conversations(spark, sf).where(F.col("role") == "assistant"), keys, table)
    out = out.join(batch.withColumnRenamed("margin", "by_batch"), keys, "left")
    return out.select(*keys, F.coalesce(F.abs(F.col("margin") - F.col("by_batch")) < 1e-6, F.lit(False)).alias("as_batch"),
                      (F.col("medical") == (F.col("margin") > 0)).alias("label_is_sign"),
                      F.col("confidence").between(0.5, 1.0).alias("confidence_in_range"))


def q_stream_turn_numbers_after_batch(spark, sf):
    """The first half of every conversation numbered as a batch, the rest by a stream that
    starts from its state; together they are the numbers of the whole."""
    from parley.streaming import turns
    conv = tables.conversations(spark, sf)
    half = F.expr("turn IS NOT NULL AND turn < 3")
    before = transcript.chat_events(conv.where(half))
    events = turns.events_of(turns.read_stream(spark, sf).where(~half))
    streamed = turns.run_to_table(turns.number_turns_stream(events, after=before), spark, "turn-numbers")
    names = ["conv_id", "turn", "epoch", "turn_no"]
    return transcript.number_turns(before).select(*names).unionByName(streamed.select(*names))


def q_stream_panels(spark, sf):
    """The panel views kept up to date by a stream of turns."""
    from parley.streaming import panels, turns
    path = turns.scratch(spark, "panels")
    turns.panel_stream(turns.read_stream(spark, sf), classifier.demo_model(spark), path, buckets=16)
    return panels.history(spark, path)


def q_stream_process_turns(spark, sf):
    from parley.streaming import turns
    out = turns.process_stream(spark, sf, classifier.demo_model(spark))
    return out.select("conv_id", "turn", "speaker", "src_lang", "tgt_lang", "original",
                      "medical", _r("confidence"), "simplified", "translation", "error")


#: Queries that SQL can't express, and what tests hold them against.
NO_SQL = {"audit_alignment": "a full edit table in tests/test_alignment.py"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # corpus
        "filter_nonempty": q_filter_nonempty,
        "extract_user_text": q_extract_user_text,
        "extract_user_text_nested": q_extract_user_text_nested,
        "extract_user_text_jsonl": q_extract_user_text_jsonl,
        "filter_nonblank": q_filter_nonblank,
        "corpus_build": q_corpus_build,
        "class_counts": q_class_counts,
        "balanced_sample": q_balanced_sample,
        "stratified_split": q_stratified_split,
        "class_weights": q_class_weights,
        # text functions
        "tokens": q_tokens,
        "ngrams": q_ngrams,
        "html_escape": q_html_escape,
        "prompt_build": q_prompt_build,
        "turn_tags": q_turn_tags,
        # features
        "term_stats": q_term_stats,
        "vocab_topk": q_vocab_topk,
        "vocab_topk_two_pass": q_vocab_topk_two_pass,
        "idf_table": q_idf_table,
        "tfidf": q_tfidf,
        # scoring / evaluation
        "svm_score": q_svm_score,
        "classify_turns": q_classify_turns,
        "eval_metrics": q_eval_metrics,
        "confusion": q_confusion,
        "misclassified": q_misclassified,
        "svm_gradient": q_svm_gradient,
        "svm_train_eval": q_svm_train_eval,
        # routing
        "direction_gate": q_direction_gate,
        "lang_lookup": q_lang_lookup,
        "lang_unknown": q_lang_unknown,
        "backend_route": q_backend_route,
        "working_text": q_working_text,
        "turn_steps": q_turn_steps,
        "process_turns": q_process_turns,
        # rewrite / translate backends
        "glossary_simplify": q_glossary_simplify,
        "glossary_simplify_joined": q_glossary_simplify_joined,
        "simplify_turns": q_simplify_turns,
        "translate_turns": q_translate_turns,
        "translate_documents": q_translate_documents,
        "translate_documents_joined": q_translate_documents_joined,
        "translate_lattice": q_translate_lattice,
        "turn_errors": q_turn_errors,
        # audits
        "audit_negation": q_audit_negation,
        "audit_numbers": q_audit_numbers,
        "audit_alignment": q_audit_alignment,
        "audit_alignment_cut": q_audit_alignment_cut,
        "audit_script": q_audit_script,
        "audit_length": q_audit_length,
        "audit_length_rewrite": q_audit_length_rewrite,
        # transcripts
        "turn_numbers": q_turn_numbers,
        "conversation_epochs": q_conversation_epochs,
        "bilingual_views": q_bilingual_views,
        "panel_history": q_panel_history,
        "bilingual_pairs": q_bilingual_pairs,
        # streaming
        "stream_turn_numbers": q_stream_turn_numbers,
        "stream_turn_numbers_after_batch": q_stream_turn_numbers_after_batch,
        "stream_panels": q_stream_panels,
        "stream_process_turns": q_stream_process_turns,
        "stream_score_turns": q_stream_score_turns,
        # sinks
        "turn_append": q_turn_append,
    }
