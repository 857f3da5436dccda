"""vocaframe: speech-corpus preparation on Spark DataFrames.

Subpackages:
  functions  Column -> Column expressions (normalization, tokens, prompts, vectors)
  operators  DataFrame -> DataFrame steps (manifest, corpus, segments, similarity,
             requests, metrics, audio, shuffle)
  sources    readers and writers (manifest text, audio files, JSONL corpus, CSV)
  streaming  the map-only steps on a streaming DataFrame
  plans      the registered queries over the driver's tables
"""

__version__ = "0.1.0"
