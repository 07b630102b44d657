"""The pronunciation lexicon source: a term, a tab and what is spoken, a line each."""

from __future__ import annotations

# Terms and how they are spoken, in the order in which they win.
SPOKEN = [
    ("Coq", "cock"), ("Pkl", "pee kay ell"), ("Dhall", "dee-hall"), ("CEL", "sell"), ("Aeneas", "uh-nee-us"), ("Creusot", "kruh-zoh"),
    ("MIR", "em eye are"), ("ITrees", "eye-trees"), ("ITree", "eye-tree"), ("POSIX", "pozzix"), ("NUMA", "new-muh"), ("RAIDs", "raids"),
    ("YAML", "yammel"), ("NoSQL", "no sequel"), ("MySQL", "my sequel"), ("SQLite", "sequel light"), ("PostgreSQL", "postgres"),
    ("arXiv", "archive"), ("ArXiv", "archive"), ("arxiv", "archive"),
]


def parse(source: str) -> list[tuple[str, str]]:
    """The entries of a lexicon text, in order; blank lines and comments are skipped.

    A line without a tab, or without a term, is an error.
    """
    out = []
    for number, line in enumerate(source.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        term, tab, spoken = line.partition("\t")
        if not tab or not term.strip():
            raise ValueError(f"line {number} of the lexicon has no term and replacement: {line!r}")
        out.append((term.strip(), spoken.strip()))
    return out
