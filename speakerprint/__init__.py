"""Conversation-fingerprint analytics on Spark DataFrames."""

from speakerprint.operators.embed import embed
from speakerprint.operators.hypervectors import fingerprints, hv_bundle, hv_encode, hv_merge
from speakerprint.operators.match import identify, message_similarity, rank_candidates, retrieve
from speakerprint.session import get_session, shared_dir, ship
from speakerprint.sources.archives import ingest_archives
from speakerprint.sources.conversations import read_messages
from speakerprint.sources.fingerprints import read_fingerprints, write_fingerprints
from speakerprint.streaming.fingerprints import read_stream_fingerprints, stream_fingerprints

__version__ = "0.1.0"

__all__ = [
    "embed",
    "fingerprints",
    "get_session",
    "hv_bundle",
    "hv_encode",
    "hv_merge",
    "identify",
    "ingest_archives",
    "message_similarity",
    "rank_candidates",
    "read_fingerprints",
    "read_messages",
    "read_stream_fingerprints",
    "retrieve",
    "shared_dir",
    "ship",
    "stream_fingerprints",
    "write_fingerprints",
]
