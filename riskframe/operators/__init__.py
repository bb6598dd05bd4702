"""Table operators: ranking, sampling, sequences, features, evaluation, models, explanations, reports."""
