"""The row-wise operators on unbounded inputs."""
