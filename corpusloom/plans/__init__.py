"""End-to-end flows, and the queries registered with their SQL twins."""
