"""Readers and writers of recordings, trajectories, point files, archives, messages and exports."""
