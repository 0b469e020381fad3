"""The same header has the same licence in a small and a large corpus."""

from sheetloom.llm import licenses

SHARES = {"the": 0.9, "under": 0.3, "license": 0.1, "licensed": 0.05, "released": 0.05, "version": 0.1, "all": 0.5,
          "apache": 0.005, "mit": 0.005}


def test_scores_do_not_depend_on_the_number_of_files():
    for text, name in (("Copyright 2021 Jane Doe. Released under the MIT License.", "MIT"),
                       ("Foo Project - licensed under the Apache License, Version 2.0", "Apache-2.0")):
        found = [licenses.Matcher(n, {t: max(1, int(n * p)) for t, p in SHARES.items()}).best(text)
                 for n in (1000, 100_000, 10_000_000)]
        assert [f[0] for f in found] == [name] * 3, found
        assert max(f[1] for f in found) - min(f[1] for f in found) < 0.02, found
