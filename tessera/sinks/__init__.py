"""Writers: id lists, documents, artifacts, metrics, models."""
