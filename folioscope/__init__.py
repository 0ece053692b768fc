"""folioscope: a Spark-native engine for auditing large corpora of serialized text.

Layers, from the bottom up:

* ``functions``  - column functions (text keys, tokens, similarities, headings, ids)
* ``sources``    - scans and sinks (tables, HTML, EPUB and DOCX packages, logs, versions)
* ``operators``  - DataFrame operators (segmentation, alignment, detectors, corrections, state)
* ``plans``      - named queries over the project tables, with their SQL twins
* ``streaming``  - event-stream operators (Structured Streaming)
* ``llm``        - operators for training-data preparation; nothing else imports it
"""

__version__ = "0.1.0"
