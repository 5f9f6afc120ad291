"""Readers: raw items, nested items, review pages, snapshots, shared folder."""
