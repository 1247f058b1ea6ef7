"""Readers and writers of vocabularies, merge tables, configurations and tagged inputs."""
