"""The quality rules' Python counts are made once in each pass over the texts, though a filter asks for them too."""

from strandline.llm import quality


def _passes(df):
    """How many Python steps the rows of df go through."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_counts_are_made_once_a_pass(docs_of):
    docs = docs_of([(i, f"stone light {i} night water " * 6, "en", "a") for i in range(40)])
    rows = quality.measured(docs.select("text", "lang", "source")).withColumns(quality.group_keys())
    assert _passes(quality.sketches(rows)) == 1
    assert _passes(quality.keep_good(docs)) == 1
