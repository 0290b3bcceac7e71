"""Spark jobs for legal-document corpora, retrieval and question-answering analytics."""
