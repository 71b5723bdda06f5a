"""Spark operators for point clouds, depth images, meshes, grasp labels and training text."""
