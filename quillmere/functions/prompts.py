"""What models are asked, as templates that are filled by column expressions; a missing value is an empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions import text as X

#: One template for each kind of call, with the names of its values.
TEMPLATES = {
    "route": "Earlier turns:\n${history}\n\nDoes this message need the documents, in which language is it, and what does it name?\n${question}",
    "decompose": "Split this question into at most ${most} searches that can be made alone. Say whether it wants a complete list and whether it is complex.\n${question}",
    "summary": "Document ${document}, below ${parent}. Its parts: ${children}.\nSummarise this ${type} named ${name} in two sentences:\n${content}",
    "metadata": "Which terms does this ${type} named ${name} define, which does it mention, and under which other names?\n${content}",
    "sufficiency": "Question: ${question}\nGaps so far: ${gaps}\n\nEvidence by search:\n${evidence}\n\nWhich searches are still missing?",
    "answer": "Answer in ${language}, from this evidence only, and cite the ids in brackets.\n${evidence}\n\nQuestion: ${question}",
    "describe": "Describe the concept ${name} in one sentence, from where it is defined:\n${context}",
    "same": "Is ${term} another name of ${name} (${description})? Say yes or no.",
    "extract": "Page ${page}. It goes on in ${section}; open containers: ${containers}; the last unit was ${last}.\nList its units with type, name, parent and content.",
}


def prompt(kind: str, **values: Column) -> Column:
    """The prompt of ``kind`` with its values put in; all names of its template have to be given."""
    names = {n for n in TEMPLATES[kind].split("${")[1:] for n in [n.partition("}")[0]]}
    if names != set(values):
        raise ValueError(f"{kind} takes {sorted(names)}")
    return X.filled_template(TEMPLATES[kind], {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in values.items()})


def prompt_sql(kind: str, **values: str) -> str:
    """The same as SQL."""
    out = "'" + TEMPLATES[kind].replace("'", "''") + "'"
    for k, v in values.items():
        out = f"replace({out}, '${{{k}}}', coalesce(cast({v} AS VARCHAR), ''))"
    return out
