"""Streams of images into stores."""
