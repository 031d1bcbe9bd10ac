"""DataFrame operators: corpus, sampling, features, classifier, evaluation,
rewriting, batched inference, routing, audits and transcripts."""
