"""The router: query features, splits, the training table, models of a question's fusion weight, and their evaluation."""
