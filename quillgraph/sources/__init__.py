"""Readers and writers of files: notes, wiki pages, DOCX, code, inventories."""
