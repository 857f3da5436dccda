"""Readers and writers."""

from .audio import list_audio, read_audio, read_contents, read_headers, with_existence, write_wav_files  # noqa: F401
from .audio_frames import read_audio_frames  # noqa: F401
from .corpus import read_corpus, write_corpus, write_training_table  # noqa: F401
from .manifest import read_lines, read_manifest  # noqa: F401
