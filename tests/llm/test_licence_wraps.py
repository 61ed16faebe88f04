"""Hard-wrapped licence notices, bare and in comments, are judged as whole paragraphs."""

import pytest

from patchloom.llm import licences

ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
NOTICES = {ISC: "isc", MIT: "mit", BSD: "bsd", GPL.format(2): "gpl-2.0", GPL.format(3): "gpl-3.0", "Copyright 2020 Ann\n\nThis is free and unencumbered software released into the public\ndomain.": "public-domain"}
TAGS = "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: BSD-3-Clause\n// Licensed under CC BY-NC 4.0\n// Released under the ISC License"


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl ", "> "])
def test_wrapped_notices(spark, mark):
    texts = ["\n".join(f"{mark}{line}".rstrip() for line in f"Some words before.\n\n{t}\n\nand after".split("\n")) for t in NOTICES]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.licences, r.n_unknown) for r in sorted(got)] == [(want, 0) for want in NOTICES.values()]


def test_line_ends_and_one_line_notices_next_to_each_other(spark):
    rows = [(1, ISC.replace("\n", "\r\n")), (2, TAGS), (3, f"/* {MIT} */\n{GPL.format(3)}\n{BSD}")]
    got = {r.doc_id: (r.licences, r.n_licences) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("isc", 1), 2: ("bsd,cc-by-nc,isc,mit", 4), 3: ("bsd,gpl-3.0,mit", 3)}


def test_long_runs_take_linear_time(spark):
    """A megabyte of blanks after a full stop, of tags on one line, and of marks: each in seconds."""
    import time

    texts = ["mit license." + " " * 1_000_000 + "x", "spdx-license-identifier mit " * 36_000, "mit license.\n" + "* # // " * 150_000, "mit license" + ".\"')" * 250_000, "mit license\n" + " \n" * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k in range(len(texts)):
        began = time.perf_counter()
        assert docs.where(f"doc_id = {k}").select(licences.F.size(licences.paragraphs(licences.F.lower("text")))).first()[0] > 0
        assert time.perf_counter() - began < 12, k
