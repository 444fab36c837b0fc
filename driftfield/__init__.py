"""driftfield: Spark-first analytics for latent trajectories in event-structured recordings."""
