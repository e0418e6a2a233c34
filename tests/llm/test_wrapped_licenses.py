"""License statements that are broken over lines."""

import pytest

from jobmart.llm import licenses

ROWS = [
    ("bsd-3-clause", "# Redistribution and use in source and binary forms, with or without\n"
     "# modification, are permitted provided that the following conditions\n# are met:\n"),
    ("mpl-2.0", "Intro.\n\n * This Source Code Form is subject to the terms of the Mozilla\n"
     " * Public License, v. 2.0. If a copy was not distributed\n"),
    ("lgpl", "This library is\nlicensed under the GNU Lesser\nGeneral Public\nLicense."),
    # the words of a statement, but far from one another
    ("", "Mozilla " + "a " * 40 + "\npublic license v 2 0 " + "b " * 40 + "\nterms of the subject"),
    ("", "Mozilla\n\nis a name"),
]


@pytest.mark.parametrize("at", range(len(ROWS)))
def test_wrapped_statement(spark, at):
    label, text = ROWS[at]
    docs = spark.createDataFrame([(1, text), (2, text + "\nx")], "doc_id long, text string")
    for row in licenses.scanned(docs).collect():
        labels = row["labels"].split(",")
        assert label in labels
        assert label or labels == [""]
        assert label != "bsd-3-clause" or row["score"] == 1.0
