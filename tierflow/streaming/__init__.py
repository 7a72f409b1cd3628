from tierflow.streaming.ingest import dedup_stream, ingest_stream, merge_stream, merged_rows, stream_files

__all__ = ["dedup_stream", "ingest_stream", "merge_stream", "merged_rows", "stream_files"]
