"""Structured Streaming: the band join over arriving statements and ledger rows (an extension; the batch operators need none of it)."""
