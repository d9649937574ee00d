"""Relational operators over documents, blocks, predictions and manifests."""
