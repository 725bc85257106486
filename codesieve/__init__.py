"""Source-code review at corpus scale, as Spark DataFrame jobs.

The main path is ``files -> file results -> repository rollups -> digests``:

* :mod:`codesieve.sources`    tables in and out (file corpora, API exports, linter reports, logs)
* :mod:`codesieve.rules`      rule packs: named boolean Column expressions plus their issue attributes
* :mod:`codesieve.operators`  scans, metrics, scores, rollups, dependency and import extraction
* :mod:`codesieve.plans`      whole jobs built from the operators
* :mod:`codesieve.streaming`  the same scan over a stream of files
"""
