"""No query of this engine is a stream; shards that arrive one by one go through sources.files.write_shards in foreachBatch."""
